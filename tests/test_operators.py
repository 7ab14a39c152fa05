import gzip
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from loomtext.functions import hashing as H
from loomtext.operators import dedup, embed, ring, stats
from loomtext.plans import config as C
from loomtext.plans.pipeline import TextPipeline
from loomtext.sources import files, sinks
from loomtext.streaming import live


def greedy(texts, threshold):
    kept = []
    words = [set(t.lower().split()) for t in texts]
    for i, t in enumerate(texts):
        key = (len(t) // 100, len(t.split()) // 10)
        if not any(texts[j].lower().strip() == t.lower().strip() or ((len(texts[j]) // 100, len(texts[j].split()) // 10) == key and len(words[i] & words[j]) >= threshold * len(words[i] | words[j])) for j in kept):
            kept.append(i)
    return kept


@pytest.mark.parametrize("partitions", [1, 5])
def test_greedy_chunks(spark, partitions):
    rng = random.Random(3)
    texts = ["a b c d e f", "a b c d e g", "a b c d h g", "A B c d e f", " a b c d e f "] + [" ".join(rng.choices("pqrstu", k=5)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string").repartition(partitions)
    assert sorted(r[0] for r in dedup.greedy_chunks(df, "i", "t", 0.7).select("i").collect()) == greedy(texts, 0.7)


def test_greedy_sentences(spark):
    docs = [(1, "One sentence alone here"), (2, "One sentence alone here"), (3, "The first thing said. Another thing said."), (4, "The first thing said! Something new was said."), (5, "The first thing said. Another thing said.")]
    got = dict(dedup.greedy_sentences(spark.createDataFrame(docs, "doc_id bigint, text string")).collect())
    assert got[1] == got[2] == "One sentence alone here"
    assert got[3] == docs[2][1] and got[4] == "Something new was said." and got[5] == ""


def test_trigram_greedy(spark):
    texts = ["hello world", "hello world!", "hello world", "other text", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string")
    assert sorted(r[0] for r in dedup.trigram_greedy(df, "i", "t", 0.8).select("i").collect()) == [0, 3, 4]


def test_ring(spark):
    df = spark.createDataFrame([(k,) for k in range(300)], "k bigint")
    found = ring.places(["a", "b", "c"], 5)
    import hashlib

    want = {k: next((n for p, n in found if p >= hashlib.md5(str(k).encode()).hexdigest()), found[0][1]) for k in range(300)}
    assert {r.k: r.node for r in ring.assign(df, "k", ["a", "b", "c"], 5).collect()} == want
    assert {r.k: r.node for r in ring.replicas_of(df, "k", ["a", "b", "c"], 2, 5).where("rank = 0").collect()} == want


def test_limits(spark):
    import pandas as pd

    at = lambda *s: spark.createDataFrame(pd.DataFrame({"k": 1, "i": range(len(s)), "ts": pd.to_datetime(list(s), unit="s")}))
    flags = lambda df, c: [r[0] for r in df.orderBy("i").select(c).collect()]
    assert flags(stats.debounce(at(0, 0.6, 1.2), "k", "ts", 1), "accepted") == [True, False, True]
    assert flags(stats.tumbling_limit(at(0, 1, 2, 61), "k", "ts", 2), "admitted") == [True, True, False, True]
    assert flags(stats.sliding_limit(at(0, 1, 2, 60.5), "k", "ts", 2, 60), "admitted") == [True, True, False, True]
    t = spark.createDataFrame([(1, i, 1.0 if i < 10 else 5.0) for i in range(11)], "k int, i int, v double")
    z = [r.z for r in stats.regressions(t, "k", "i", "v").orderBy("i").collect()]
    assert z[:9] == [None] * 9 and z[9] == 0 and z[10] > 2


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id").limit(300)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    for k, (stream, same) in enumerate(((live.debounce_stream, stats.debounce), (lambda s, *a: live.sliding_limit_stream(s, *a[:2], 2, 86400), lambda d, *a: stats.sliding_limit(d, *a[:2], 2, 86400)))):
        s = stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "user_id", "ts", 43200)
        s.writeStream.trigger(availableNow=True).format("memory").queryName(f"out{k}").option("checkpointLocation", str(tmp_path / f"c{k}")).start().awaitTermination()
        want = same(batch, "user_id", "ts", 43200)
        assert sorted(r.event_id for r in spark.table(f"out{k}").collect()) == sorted(r.event_id for r in want.where(want[want.columns[-1]]).collect())


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("hello there", encoding="utf-8")
    (tmp_path / "in/b.bin").write_text("no", encoding="utf-8")
    q = live.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), lambda b: files.extract(b.withColumn("file_type", F.lit("txt"))).select("path", "text"), str(tmp_path / "c"))
    q.awaitTermination()
    assert [r.text for r in spark.read.json(str(tmp_path / "out/*")).collect()] == ["hello there"]


def test_files(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "noname").write_bytes(data.getvalue())
    (tmp_path / "b.html").write_text("<nav>n</nav><script>s</script><p>x  y</p>\n<p> z</p>", encoding="utf-8")
    (tmp_path / "c.txt").write_bytes(b"caf\xe9 ok")
    (tmp_path / "d.docx").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text == got["noname"].text == "Para\nc1 c2 \n"
    assert got["b.html"].text == "x\ny\nz" and got["c.txt"].text == "caf ok"
    assert got["d.docx"].extract_error and got["d.docx"].text is None
    assert files.decompress("x.gz", gzip.compress(b"y")) == b"y" and files.uri("s3://b/k") == "s3a://b/k"
    assert files.email_text(b"Subject: Hi\nContent-Type: text/plain\n\nBody\n") == "Subject: Hi\n\nBody\n"


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbad\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int", strict=False).collect()) == [1, 2]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    df = spark.createDataFrame([(1, None)], "a int, b string")
    for kind in ("jsonl", "parquet"):
        sinks.write(df, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).collect() == df.collect()
    sinks.write(df, str(tmp_path / "one.json"), "json")
    assert (tmp_path / "one.json").read_text() == '[{"a": 1, "b": null}]'


def test_embedding(spark):
    v = [r[0] for r in spark.createDataFrame([("a b c",), (None,), ("a b c",)], "t string").select(embed.encode("t")).collect()]
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-6 and v[0] == v[2] and not any(v[1])


def test_config():
    with pytest.raises(ValueError):
        C.Config().override({"chunking.chunk_overlap": 500, "chunking.chunk_size": 400})
    c = C.from_environment(environ={"LOOMTEXT_CHUNKING__CHUNK_SIZE": "200", "LOOMTEXT_CLEANING__REMOVE_STOPWORDS": "false"})
    assert c.chunking.chunk_size == 200 and not c.cleaning.remove_stopwords
    assert C.difference(C.Config(), c).keys() == {("chunking", "chunk_size"), ("cleaning", "remove_stopwords")}
    assert C.Config().override({"chunking.chunk_size": 300}, allowed=set()) == C.Config()


def test_pipeline(spark, tmp_path):
    sample = "\n    This is a sample document for testing. It contains multiple sentences that need processing.\n    Some sentences have   extra   whitespace. Others contain HTML tags like <b>bold text</b>.\n    "
    got = TextPipeline().process_text(spark, sample).chunks.collect()
    assert [(r.chunk_id, r.text) for r in got] == [("text_input_0", "sample document testing. contains multiple sentences need processing. sentences extra whitespace. Others contain HTML tags like <b>bold text</b>.")]
    assert (got[0].start_char, got[0].end_char, got[0].text_hash) == (0, 145, "1e4be90c81370a99")
    for n in "ab":
        (tmp_path / f"{n}.txt").write_text(sample, encoding="utf-8")
    (tmp_path / "c.docx").write_bytes(b"no")
    r = TextPipeline().process_files(spark, str(tmp_path))
    assert r.chunks.count() == 1 and r.errors.count() == 1 and r.stats.first().total_chunks == 1
    r.write(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_numbered(spark):
    from loomtext.plans.pipeline import numbered

    paths = [f"p{i:04d}" for i in range(500)]
    got = numbered(spark.createDataFrame([(p,) for p in random.Random(1).sample(paths, 500)], "path string").repartition(7), "path", "doc_id").collect()
    assert sorted((r.doc_id, r.path) for r in got) == list(enumerate(paths))


def test_normal_form_and_offsets(spark):
    from loomtext.functions import text as T
    from loomtext.operators import chunking

    rows = [("cafe\u0301",), ("plain",), (None,), ("",), ("caf\u00e9",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.to_normal_form("t")).collect()]
    assert got == ["caf\u00e9", "plain", None, "", "caf\u00e9"]
    words = [f"w{'x' * (i % 7)}" for i in range(333)]
    for size, overlap in ((10, 3), (1, 0), (400, 5), (333, 0)):
        pieces = spark.createDataFrame([(" ".join(words),)], "t string").select(chunking.word_chunks("t", size, overlap)).first()[0]
        for i, p in enumerate(pieces):
            assert p.text == " ".join(words[i * (size - overlap) :][:size])
            assert p.start_char == len(" ".join(words[: i * (size - overlap)])) and p.end_char == p.start_char + len(p.text)


def test_lsh(spark):
    rng = random.Random(1)
    base = [[f"w{rng.randrange(5000)}" for _ in range(80)] for _ in range(20)]
    rows = [(i, b) for i, b in enumerate(base)] + [(100 + i, b[:76] + ["x", "y"]) for i, b in enumerate(base)]
    got = {(r.a, r.b) for r in dedup.lsh_pairs(spark.createDataFrame(rows, "i bigint, s array<string>"), "i", "s", 0.85).collect()}
    assert got == {(i, 100 + i) for i in range(20)}
    assert H.coefficients(3) == H.coefficients(3)
