"""Operators for training data against brute force, on small tables with the awkward cases:
nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns."""

import random
import re
import time
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmill.llm import ann, html_main, language, mixing, near_dup, packing, quality_model, quality_rules, toxicity, url_filter
from rowmill.llm import oracle_sql, queries
from rowmill.llm.queries import URL_RULES, tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double"
BASE = " ".join(f"word{i}" for i in range(120))
TEXTS = [None, "", "  \n\t ", "a", "a b", "A B", "a b c a b c a b c", BASE, BASE, BASE.replace("word60", "other"), BASE.upper(), "x\u00a0y z\x1cq \u00e9t\u00e9", "line one\nline one\n\nline two\n line one\nline one", "w " * 30_000, "##$ %% | a", "\U0001f600 ok <|endoftext|> more", " ".join(f"v{i}" for i in range(60))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, [None, "b", "a", "B"][i % 4], len(t or ""), 7, 0.5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[7], (None, BASE, "fr", "a", 1, 7, 0.5)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_quality_statistics(docs, none):
    for r in quality_rules.quality_verdicts(docs).collect():
        if r.doc_id is None:
            continue
        t = TEXTS[r.doc_id] or ""
        w = words(t)
        win = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {i + k for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert quality_rules.quality_verdicts(none).count() == 0


def test_near_duplicates_against_all_pairs(docs, none):
    def shingles(t):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in enumerate(TEXTS)}
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in combinations(sets, 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    got = near_dup.near_duplicates(docs, words=3, percent=85).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)
        else:
            assert r.component_id is None and r.kept
    with pytest.raises(TypeError):
        near_dup.near_duplicates(docs.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert near_dup.near_duplicates(none).count() == 0


def test_near_duplicates_against_their_sql(spark, docs, tmp_path):
    """The given documents, and the awkward ones under ids of their own (a null id has no SQL)."""
    odd = docs.where("doc_id is not null").select((F.col("doc_id") + 10**6).alias("doc_id"), "text")
    spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["op8_near_dup"](spark, str(tmp_path)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(oracle_sql()["op8_near_dup"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and not all(r.kept for r in got)


def test_near_duplicates_between_texts_that_are_never_centres(spark):
    """The exact join for what stars leave: every near pair among texts that share a passage."""
    rng = np.random.default_rng(4)
    passage = [f"shared{i}" for i in range(60)]
    texts = []
    for i in range(40):
        own = [f"own{i}x{j}" for j in range(int(rng.integers(20, 60)))]
        texts.append(" ".join(passage + own))
        if i % 4 == 0:
            texts.append(" ".join(passage + own[:-2]))
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(words, texts)]
    want = {(a, b) for a, b in combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    members = docs.select(F.col("id").alias("rep"), F.col("id").alias("label"))
    pairs = near_dup.prefix_pairs(members, docs, 3, 85)
    assert {(r.x, r.y) for r in near_dup.confirm(pairs, docs, 3, 85).collect()} == want and want


def test_hot_stars_and_buckets_are_split(spark, monkeypatch):
    """With tiny limits on what one task gets, the links are the same as those of all pairs."""
    monkeypatch.setattr(near_dup, "SPREAD", 4)
    monkeypatch.setattr(near_dup, "PAIRS", 3)
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for i in range(60):  # near copies of one text; some are near others only
        w = list(base)
        for j in rng.choice(100, int(rng.integers(1, 6)), replace=False):
            w[j] = f"e{i}x{j}"
        texts.append(" ".join(w))
    texts += [" ".join(f"o{i}y{j}" for j in range(50)) for i in range(20)]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(words, texts)]
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in combinations(range(len(texts)), 2):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    got = near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))


def test_bands_suit_the_limit():
    assert near_dup.banding(85) == (44, 10)
    for percent in (70, 80, 85, 90):
        bands, width = near_dup.banding(percent)
        assert (1 - (percent / 100) ** width) ** bands <= near_dup.MISS and bands * width <= 440


def test_mixing(spark, docs, none):
    out = mixing.mixed(docs, block=16).collect()
    assert len(out) == docs.count()
    assert all(r.taken <= 3 * r["size"] for r in out)
    assert all(r["size"] == len(words(TEXTS[r.doc_id])) for r in out if r.doc_id is not None)
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
    total = sum(r["size"] for r in out)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6 * total + 1e-6
    for v in by.values():
        assert v[0].target <= 3 * v[0].source_size + 1e-6
        assert abs(sum(r.taken for r in v) - v[0].target) <= 48
    again = mixing.mixed(docs.repartition(5), block=16).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mixing.mixed(none).count() == 0 and mixing.rebuilt(none).columns == none.columns
    assert mixing.rebuilt(docs).columns == docs.columns


def test_mixed_texts_are_the_blocks_drawn(spark):
    text = "  " + "".join(f"w{i}" + (" ", "\n\n", "\t")[i % 3] for i in range(1000))
    rows = [(1, text, "en", "a", 0), (2, "x y\n z", "en", "a", 0), (None, "p  q", "en", "b", 0), (None, "p  q", "fr", "b", 0), (3, " ".join(f"v{i}" for i in range(600)), "en", "b", 0), (4, None, "en", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = {}
    for r in mixing.mixed(df, block=16).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    out = mixing.rebuilt(df, block=16).collect()
    got, said = {}, {None: "p  q", **{r[0]: r[1] for r in rows if r[0]}}
    for r in out:
        assert r.text in said[r.doc_id] and r.n_chars == len(r.text)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
    assert got == {k: v for k, v in taken.items() if v}
    # source b weighs less than its size: the blocks drawn are not its document's first words
    tails = [r for r in out if r.doc_id == 3 and not r.text.startswith("v0 ")]
    assert tails and max(int(w[1:]) for r in tails for w in words(r.text)) > 300
    assert {r.lang for r in out if r.doc_id is None} <= {"en", "fr"}


def test_shards_are_multinomial_draws(spark, docs):
    rows = [("a", 400, 40_000, 20_000.0), ("b", 400, 40_000, 60_000.0)]
    s = mixing.slots(spark.createDataFrame(rows, "source string, n_rows long, source_size long, target double"), 4, shard=100)
    n = {(r.shard, r.source): r.n_slots for r in mixing.shard_counts(s).collect()}
    assert sorted(r.slot for r in s.select("slot").collect()) == list(range(20_000))
    a = np.array([n.get((k, "a"), 0) for k in range(200)])
    assert a.sum() == 5_000 and all(a[k] + n.get((k, "b"), 0) == 100 for k in range(200))
    # variance of 100 draws of share 1/4 without replacement: 18.66
    assert 12 < a.var() < 27
    out = mixing.mixed(docs, block=16, shard=8).collect()
    at = [(r.shard, r.slot) for r in out if r.taken]
    assert at == sorted(at) and all(k == v // 8 for k, v in at) and all(r.slot is None for r in out if not r.taken)
    # repeats of a text lie apart
    many = spark.createDataFrame([(i, f"t{i} " * 30, "en", "a" if i % 5 else "b", 0) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    ids = [r.doc_id for r in mixing.rebuilt(many, block=30).collect()]
    assert sum(x == y for x, y in zip(ids, ids[1:])) < len(ids) / 20


def test_packing_is_an_exact_cover(spark, docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for t in TEXTS]
    got = packing.packed(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), tokenizer_path()).collect()
    by, seqs = {}, {}
    for r in got:
        ids = np.frombuffer(bytes(r.token_ids), "<u4").tolist()
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        by.setdefault(r.doc_id, []).append((r.start, ids))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, w in enumerate(want):
        flat = []
        for start, ids in sorted(by[i]):
            assert start == len(flat)
            flat += ids
        assert flat == w
    for pieces in seqs.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.packed(none, tokenizer_path()).count() == 0


def test_tiers_are_packed_each_for_itself():
    rng = np.random.default_rng(1)
    total = (np.exp(rng.normal(5.5, 1.2, 3000)).astype(int) + 1).tolist()
    items = [(t % 1024, packing.tier_of(t)) for t in total if t % 1024]
    seqs = packing.pack(items)
    done, kinds = Counter(), Counter()
    for size, s in seqs:
        assert sum(k for *_, k in s) == size
        kinds[size] += 1
        for n, start, k in s:
            done[n] += k
    assert [done[i] for i in range(len(items))] == [n for n, _ in items]
    # every tier has sequences of its own size, and at most ten others are tails
    assert all(kinds[x] > 50 for x in (128, 256, 512, 1024)) and sum(n for x, n in kinds.items() if x not in (128, 256, 512, 1024)) <= 10
    # documents of a tier lie in its sequences or, as fillings, in longer ones
    for size, s in seqs:
        assert all(128 << items[n][1] <= max(size, 128) for n, *_ in s if size in (128, 256, 512, 1024))
    flat = packing.pack([(n, 3) for n, _ in items])
    assert sorted(tuple(s) for _, s in flat) != sorted(tuple(s) for _, s in seqs)


def test_ids_are_those_of_tokenizers():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path())
    rng = random.Random(1)
    parts = ["<|endoftext|>", "<|endof", " ", "  ", "\n", "\t", "\r\n", "x", "Don't", "'s", "\u00e9", "\u6f22\u5b57", "123", " !?", "\u00a0", "\u2028", *map(chr, range(256))]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    texts += ["x <|endoftext|> y", "a" * 100_000, " " * 1_000_000 + "x", "\n" * 200_000, "".join(map(chr, range(1, 0xD800, 7)))]
    for t in texts:
        assert own(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_step_groups_share_cost(spark):
    df = spark.createDataFrame([(i, " ".join(["word"] * (1 + i * 37 % 900))) for i in range(800)], "doc_id long, text string").coalesce(1)
    rows = packing.packed(df, tokenizer_path()).collect()
    seq = {}
    for r in rows:
        s = seq.setdefault(r.sequence_id, [r.step_group, r.tier, 0])
        s[2] += r.length**2
    by = {}
    for g, tier, cost in seq.values():
        by.setdefault(g, []).append((tier, cost))
    assert all(len({t for t, _ in v}) == 1 and len(v) * v[0][0] <= 64 * 1024 for v in by.values())
    top = [sum(c for _, c in v) for v in by.values() if v[0][0] == 1024]
    assert len(top) > 2 and max(top) < 1.2 * min(top)


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.integers(-5, 5, rng.integers(1, 30)).astype(float)

        def best(lo, hi):  # divide at the best segment: the definition of maximal segments
            top = max(((s[a:b].sum(), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
            return [] if top is None or top[0] <= 0 else [*best(lo, top[3]), top[0], *best(top[4], hi)]

        assert sorted(x for *_, x in toxicity.segments(s)) == pytest.approx(sorted(best(0, len(s))))


def test_segments_take_linear_time():
    took = {}
    for n in (50_000, 200_000):
        rng = np.random.default_rng(1)
        for name, s in {"falling": np.tile([1.0, -2.0], n // 2), "rising": np.tile([2.0, -1.0], n // 2), "walk": rng.normal(-0.1, 1, n)}.items():
            began = time.process_time()
            toxicity.segments(s)
            took[name, n] = time.process_time() - began
    for name in ("falling", "rising", "walk"):
        assert took[name, 200_000] < 10 * max(took[name, 50_000], 0.02)


def test_trained_operators_take_awkward_rows(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(17)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    q = quality_model.quality_scores(docs, labels).collect()
    assert len(q) == docs.count() and all(0 <= r.score <= 1 for r in q)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in q if r.doc_id is not None)
    t = toxicity.toxic_passages(docs, toxicity.fit(docs, labels)).collect()
    assert len(t) == docs.count() and all(0 <= r.score <= 1 for r in t)
    langs = {r.doc_id: r for r in language.languages(docs).collect()}
    assert all(langs[i].lang_pred == "und" for i in (0, 1, 2)) and langs[3].lang_pred != "und"
    assert {r.score for r in quality_model.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_model.quality_scores(none, labels).count() == 0
    assert toxicity.toxic_passages(none, toxicity.fit(none, labels)).count() == 0
    assert language.languages(none).count() == 0


def test_language_profile_is_the_sum_of_bound_vectors():
    view = np.frombuffer("ab é".encode(), np.uint8)
    t, row, has = language.triples(view, np.array([0, len(view)]))
    v = language.letter_vectors()
    ids = [[0, 1, 2], [1, 2, 0], [2, 0, 27 + 0xE9 - 0xDF], [0, 27 + 0xE9 - 0xDF, 0]]
    want = sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in ids)
    assert (language.triple_vectors(t).astype(int).sum(0) == want).all() and has.all() and (row == 0).all()


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x?q#f", "http://a.example.com/en/", "http://example.com", "http://b.net/es/1", "http://net/fr/", "http://xnet/fr/", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    out = {r.page_id: r for r in url_filter.filter_urls(pages, URL_RULES).collect()}
    assert [out[i].host for i in range(10)] == ["", "", "", "www.example.com", "a.example.com", "example.com", "b.net", "net", "xnet", "b:"]
    assert [out[i].rule for i in range(10)] == [None, None, None, "www.example.com/en/", "example.com/en/", None, "net/es/", "net/fr/", None, None]
    assert out[3].verdict == "allow" and out[4].verdict == "block"
    assert out[3].path == "/en/x" and out[9].path == "//c/d"


def test_main_text(spark):
    site = "<div class=top>Same words on each page</div><p>Own text {i} &amp; more</p>"
    rows = [(i, f"http://h.org/{i}", site.format(i=i)) for i in range(12)]
    rows += [(100, None, None), (101, "http://x/", ""), (102, "http://x/", "<nav>no</nav><article><h1>T\n t</h1><p>a<br>b<p>c<script>var x='</p>'</script></article><footer>no</footer>"), (103, "http://x/", "<p>one<div class='comments'>no</div>two")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r for r in html_main.main_text(pages).collect()}
    assert out[3].text == "Own text 3 & more" and out[3].n_chars == 17
    assert out[100].text == out[101].text == ""
    assert out[102].text == "T t\n\na\n\nb\n\nc" and out[103].text == "one\n\ntwo"


def test_site_templates_on_all_pages_of_a_host(spark):
    body = "<main><p>Own text {i}</p><div class=box>Site words</div></main><div class=tail>Tail words</div>"
    rows = [(i, f"http://h.org/{i}", body.format(i=i)) for i in range(20)]
    rows += [(20 + i, f"http://h.org/{20 + i}", f"<p>Plain {i}</p><div class=box>Site words</div>") for i in range(3)]
    # copies of one page do not count again; without recurrence, what lies outside of main is kept
    rows += [(30 + i, "http://c.org/", "<article>Same</article><p>Outside</p>") for i in range(20)]
    # 10 of 300 pages are no template
    rows += [(100 + i, f"http://big.org/{i}", f"<p>Page {i}</p>" + "<p>Some pages</p>" * (i < 10)) for i in range(300)]
    out = {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "Own text 3" and out[21] == "Plain 1" and out[30] == "Same\n\nOutside"
    assert out[100] == "Page 0\n\nSome pages"


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 16))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(400, [float(v) for v in x[20]]), (401, None), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [None] * 16), (405, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("id") % 20 == 0, 20).collect()
    full = np.vstack([x, x[20]])
    hit = n = 0
    for q in [i for i in range(401) if i % 20 == 0]:
        s = full @ full[q]
        want = sorted((i for i in range(401) if i != q), key=lambda i: (-s[i], i))[:20]
        own = [r for r in got if r.query_id == q]
        assert sorted(r["rank"] for r in own) == list(range(1, 21))
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in own)
        hit, n = hit + len({r.vec_id for r in own} & set(want)), n + 20
    assert hit / n >= 0.9
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).checkpoint()
        assert docs.count() > 0
        if name != "packing":
            assert docs.columns == cols


def test_drop_copies_against_all_pairs(spark):
    import corpus_pipeline

    rng = np.random.default_rng(1)
    made = [" ".join(f"u{w}" for w in rng.integers(0, 5000, 80)) for _ in range(12)]
    near = made[0].replace(made[0].split()[40], "other")
    # exact copies with one doc_id, one doc_id with two texts, a near copy, a copy with a smaller doc_id later, nulls
    rows = [(5, made[0]), (5, made[0]), (5, made[1]), (7, near), (9, made[2]), (3, made[2]), (None, made[2]), (None, made[3]), (None, made[3]), (8, None), *((20 + i, t) for i, t in enumerate(made[4:]))]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    sets = [{tuple(words(t)[i : i + near_dup.WORDS]) for i in range(80 - near_dup.WORDS + 1)} if t else None for _, t in rows]
    alone = [i for i, (k, t) in enumerate(rows) if k is None or not t]
    want, seen = [rows[i] for i in alone], []
    for i in sorted((i for i in range(len(rows)) if i not in alone), key=lambda i: rows[i][0]):
        if not any(100 * len(sets[i] & sets[j]) >= near_dup.PERCENT * len(sets[i] | sets[j]) for j in seen):
            want.append(rows[i])
        seen.append(i)
    out = corpus_pipeline.drop_copies(spark, df, SF)
    assert out.columns == df.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, want))
