"""run() of the pipeline, stage by stage, against brute force on a table with nulls and repeats."""

import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowmill.llm import mixing, near_dup, packing, quality_rules, toxicity
from rowmill.llm import text as T
from rowmill.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    stock = [f"{a}{b}" for a in ("river", "stone", "wind", "light", "green", "paper") for b in ("s", "y", "ing", "ed", "ment", "less", "ful")]

    def prose(n):
        w = [str(x) for x in rng.choice(stock, n)]
        return " ".join(x + (". " if i % 9 == 8 else "") for i, x in enumerate(w))

    rows, labels = [], []
    for i in range(160):
        t = prose(int(rng.integers(70, 160)))
        toxic = i % 8 == 0
        if toxic:
            t += " vileword awfulword vileword nastyword awfulword vileword" * 2
        rows.append((i, t, "en", "abc"[i % 3], len(t), 0.1))
        labels.append((i, 1, int(toxic)))
    first = [r for r in rows if r[0] % 8]
    rows += [(300 + k, first[k][1], "en", "b", 1, 0.2) for k in range(10)]  # exact copies
    rows += [(320 + k, first[k + 20][1] + " tail", "fr", "a", 1, 0.2) for k in range(10)]  # near copies
    rows += [first[40], first[40], (first[41][0], first[42][1], None, None, None, None)]  # repeats of a row and of an id
    rows += [(None, first[43][1], "en", "a", 1, 0.0), (None, None, None, None, None, None), (400, "", "en", "a", 0, 0.0), (401, None, "en", "a", 0, 0.0), (402, " \n ", "en", "zz", 0, 0.0), (403, "short text", "en", "a", 0, 0.0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def listed(df, cols=("doc_id", "text", "lang", "source")):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_run_against_brute_force(spark, folder):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    at = {"documents": docs}
    for (name, stage), before in zip(P.STAGES, ["documents", *(n for n, _ in P.STAGES)]):
        at[name] = stage(spark, at[before], folder).checkpoint()
        if name != "packing":
            assert at[name].columns == docs.columns

    score = {(r.doc_id, r.text): r.s for r in docs.select("doc_id", "text", toxicity.scorer(toxicity.fit(docs, labels))("text").score.alias("s")).collect()}
    assert listed(at["toxicity"]) == Counter({k: n for k, n in listed(docs).items() if score[k[:2]] < 0.5})
    gone = {k[0] for k in listed(docs)} - {k[0] for k in listed(at["toxicity"])}
    assert gone == {i for i in range(160) if i % 8 == 0}

    good = {(r.doc_id, r.text) for r in quality_rules.quality_verdicts(at["toxicity"].withColumn("key", F.struct("doc_id", "text")), key="key").where("kept").select("key.*").collect()}
    assert listed(at["quality_rules"]) == Counter({k: n for k, n in listed(at["toxicity"]).items() if k[:2] in good})
    assert not any(k[1] is None or len(WORD.findall(k[1])) < 50 for k in listed(at["quality_rules"]))

    rows = list(listed(at["quality_rules"]).elements())
    sets = [{tuple(w[i : i + near_dup.WORDS]) for i in range(len(w) - near_dup.WORDS + 1)} for w in (WORD.findall(r[1].lower()) for r in rows)]
    root = list(range(len(rows)))
    for _ in range(3):
        for i in range(len(rows)):
            for j in range(i):
                if rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= near_dup.PERCENT * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    kept = listed(at["near_dup"])
    assert Counter(k[0] for k in kept.elements()) == Counter([*least.values(), *(None for r in rows if r[0] is None)])
    assert not kept - listed(at["quality_rules"]) and len(rows) - sum(kept.values()) >= 22

    taken = Counter()
    for r in mixing.mixed(at["near_dup"]).collect():
        taken[r.doc_id, r.source] += r.taken
    words, texts = Counter(), {(k[0], k[3]): k[1] for k in kept}
    for r in at["mixing"].collect():
        assert r.text in texts[r.doc_id, r.source]
        words[r.doc_id, r.source] += len(WORD.findall(r.text))
    assert words == Counter({k: n for k, n in taken.items() if n})

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in at["mixing"].collect():
        want[r.doc_id, len(tok.encode(r.text, add_special_tokens=False).ids) + 1] += 1
    out = at["packing"].collect()
    got = Counter()
    for r in out:
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == Counter({(d, n): c * n for (d, n), c in want.items()})
    whole = P.run(spark, folder)
    key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert whole.columns == at["packing"].columns and sum(r.length for r in whole.collect()) == sum(r.length for r in out)
    assert Counter((r.doc_id, r.doc_tokens) for r in whole.collect() if not r.start) == Counter((r.doc_id, r.doc_tokens) for r in out if not r.start), key


def test_stages_take_empty_tables(spark, folder):
    import corpus_pipeline as P

    none = spark.createDataFrame([], SCHEMA)
    for name, stage in P.STAGES:
        out = stage(spark, none, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)


def test_stages_send_texts_to_tasks_in_small_batches(spark, folder):
    import corpus_pipeline as P

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes]})

    for name, stage in P.STAGES:
        if name == "mixing":  # no Python
            continue
        fresh = spark.newSession()
        stage(fresh, fresh.read.parquet(f"{folder}/documents.parquet"), folder)
        texts = fresh.range(0, 3000, 1, 1).select(F.repeat(F.lit("some words "), 800).alias("text"))
        got = [r.bytes for r in texts.mapInArrow(sizes, "bytes long").collect()]
        assert sum(got) > 24_000_000 and max(got) < 6_000_000, name


def test_a_lower_batch_size_is_kept(spark):
    import corpus_pipeline as P

    fresh = spark.newSession()
    for given, want in (("1m", 1 << 20), ("64m", P.BATCH)):
        fresh.conf.set(P.BATCH_CONF, given)
        P.small_batches(fresh)
        texts = fresh.range(0, 3000, 1, 1).select(F.repeat(F.lit("some words "), 800).alias("text"))
        most = texts.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"bytes": [b.nbytes]}) for b in bs), "bytes long").agg(F.max("bytes")).first()[0]
        assert want // 2 < most < want * 3 // 2, given


def test_a_task_needs_little_beside_its_batch():
    """Peak of numpy's memory over 4 MB of texts; the runs of bytes looked at are what counts."""
    texts = pa.array(["River stones, winds and 12 green papers of May. " * 80] * 1000)
    model = toxicity.Model(np.ones((2, toxicity.LAST + 1, 1 << toxicity.BITS)))
    for work in (lambda: [quality_rules.measure(v, o) for _, v, o in T.views(texts)], lambda: [None for _ in model.scan(texts)], lambda: [None for _ in near_dup.shingle_sets(texts, 5)]):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 25_000_000, peak


def test_the_second_tokenizer_is_read_when_needed(monkeypatch):
    import tokenizers

    read, plain = [], tokenizers.Tokenizer

    class Counted:
        @staticmethod
        def from_file(path):
            read.append(path)
            return plain.from_file(path)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    monkeypatch.setattr(packing, "_encoders", {})
    enc = packing.encoder(tokenizer_path())
    assert len(enc("plain words")) and not read
    long = " " * 1_200_000 + "x"
    assert enc(long).tolist() == plain.from_file(tokenizer_path()).encode(long, add_special_tokens=False).ids
    assert enc(long) is not None and len(read) == 1
