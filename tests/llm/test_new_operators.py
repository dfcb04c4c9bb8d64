"""Exact dedup, divergence audit and resampling on odd rows, and their parts against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.llm import divergence, exact_dedup, resample
from tests.llm.test_operators import docs, lower, prose, rows  # noqa: F401


def dedup_expected(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[t or ""].append(k)
    out = Counter()
    for t, keys in groups.items():
        known = [k for k in keys if k is not None]
        keep = max(known, default=None)
        for k in keys:
            out[k, keep, len(keys), hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("params", [{}, {"id_bits": 3, "least": 4, "most": 16}, {"id_bits": 3, "least": 4, "most": 16, "clash_rows": 1}, {"broadcast_rows": 0}], ids=["plain", "clashing", "all clash", "shuffled"])
def test_exact_dedup(docs, rows, params):  # noqa: F811
    found = exact_dedup.duplicates(docs, params=exact_dedup.ChunkParams(**params)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == dedup_expected(rows)
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_exact_dedup_finds_clashes_and_mends_them(spark):
    """Texts whose recipes are alike by identifiers of no bits differ all the same."""
    made = [(k, "abcde"[k % 5] * 60) for k in range(20)]
    docs = spark.createDataFrame(made, "doc_id long, text string")  # noqa: F811
    params = exact_dedup.ChunkParams(least=60, most=60, id_bits=1)
    listed = exact_dedup.recipes(docs, "doc_id", "text", [], params)
    assert exact_dedup.clashes(docs, "text", exact_dedup.shared_recipes(listed), params)
    found = exact_dedup.duplicates(docs, params=params).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in found) == Counter((k, 15 + k % 5, 4) for k in range(20))


def test_exact_dedup_repeated_rows_without_ids_hot_and_long(spark):
    long = prose(random.Random(1), 300_000)
    made = [(None, "a"), (None, "a"), (1, "b"), (1, "b"), *[(k, "hot") for k in range(500)], (7, long), (8, long), (9, long[:-1])]
    docs = spark.createDataFrame([(k, t, k, "x") for k, t in made], "doc_id long, text string, n long, key string")  # noqa: F811
    for params in ({}, {"broadcast_rows": 0}):
        found = exact_dedup.drop_duplicates(docs, params=exact_dedup.ChunkParams(**params))
        assert found.columns == docs.columns
        assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter([(None, "a"), (1, "b"), (499, "hot"), (8, long), (9, long[:-1])])
    assert exact_dedup.duplicates(docs.limit(0)).count() == 0


def test_chunks_follow_content(spark):
    """A text's chunks put together are the text; past an inserted word they are soon the old ones again."""
    text = prose(random.Random(3), 20_000)
    other = text[:5000] + " inserted " + text[5000:]
    params = exact_dedup.ChunkParams()
    a, b = (r.c for r in spark.createDataFrame([(text,), (other,)], "text string").select(exact_dedup.chunks_of(F.col("text"), params).alias("c")).collect())
    assert "".join(a).encode("latin-1").decode() == text
    assert all(params.least <= len(c) <= params.most + 3 for c in a[:-1])
    assert len(set(a) & set(b)) > 0.9 * len(a)


def test_pointer_sort_orders_words(monkeypatch):
    monkeypatch.setattr(divergence, "LEAF", 50)
    rng = random.Random(5)
    words = ["".join(rng.choice("abÉß") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 24, 40]))) for _ in range(60)] + ["aaaaaaaa", "aaaaaaaab", "aaaaaaaaaaaaaaaa"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) + rng.choice(["", "7", ". "]) for _ in range(80)]
    groups = [rng.randrange(4) for _ in texts]
    folded = "\0".join(texts).encode()
    found = divergence.Words(folded.translate(divergence.FOLD), np.array([0, len(folded)]))
    order, begins = found.ordered()
    sorted_words = found.terms(order).to_pylist()
    brute = [w for t in texts for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(t))]
    assert [w.encode() for w in sorted_words] == sorted(w.encode() for w in brute)
    assert begins.tolist() == [k == 0 or sorted_words[k] != sorted_words[k - 1] for k in range(len(sorted_words))]
    terms, group, n, of_docs = divergence.counted([t.encode() for t in texts], groups)
    times, seen = Counter(), Counter()
    for t, g in zip(texts, groups):
        w = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(t))
        times.update((x, g) for x in w)
        seen.update((x, g) for x in set(w))
    assert {(t, g): (a, b) for t, g, a, b in zip(terms.to_pylist(), group.tolist(), n.tolist(), of_docs.tolist())} == {k: (times[k], seen[k]) for k in times}
    text = " ".join(texts).encode()
    assert b"".join(divergence.in_pieces(text, 30)) == text


def audit_expected(rows, least):
    docs, word = [(la or "", so or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(t))) for la, so, t in rows], Counter()  # noqa: F811
    out = Counter()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for _, _, t in mine for w in set(t))
        kept = sorted(w for w in df if df[w] >= least)
        counts = {s: Counter(w for _, so, t in mine if so == s for w in t if w in set(kept)) for s in {d[1] for d in mine}}
        word = sum(counts.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in counts.items():
            pairs = sorted((-sum(apart(share(c, w), share(o, w)) for w in kept), x) for x, o in counts.items() if x != s)
            terms = sorted((-apart(share(c, w), share(word, w)), w.encode()) for w in kept if c[w] > 0 and share(c, w) > share(word, w))
            out.update((lang, s, "pair", x, -v, k) for k, (v, x) in enumerate(pairs, 1))
            out.update((lang, s, "term", x.decode(), -v, k) for k, (v, x) in enumerate(terms[:10], 1))
    return out


def test_divergence(spark, docs):  # noqa: F811
    rows = [(r.lang, r.source, r.text) for r in docs.select("lang", "source", "text").collect()]  # noqa: F811
    odd = [(None, None, "Gamma beta gamma"), ("xx", "s", None), ("xx", "t", ""), ("en", "empty", "1 2 3"), ("en", "src1", "a" * 50 + " lon lon")]
    made = spark.createDataFrame(rows + odd, "lang string, source string, text string").withColumns({"term": F.lit(1), "n": F.lit("x"), "value": F.lit(2)})
    for least in (3, 10):
        found = divergence.audited(made, params=divergence.AuditParams(min_docs=least, broadcast_rows=0 if least == 3 else 1000))
        assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert Counter(tuple(r) for r in found.collect()) == audit_expected(rows + odd, least)
    assert divergence.audited(made.limit(0)).count() == 0


def test_divergence_counts_texts_longer_than_a_shard(spark):
    text = ("alpha beta gamma " * 40 + "omega ") * 14_000
    assert len(text) > divergence.SHARD_BYTES
    made = spark.createDataFrame([("en", "a", text), ("en", "a", "alpha")], "lang string, source string, text string")
    found = {r.term: (r.n, r.docs) for r in divergence.term_counts(made, "text", "lang", "source").collect()}
    assert found == {"alpha": (560_001, 2), "beta": (560_000, 1), "gamma": (560_000, 1), "omega": (14_000, 1)}


def test_features_in_pieces(monkeypatch):
    monkeypatch.setattr(resample, "PIECE", 7)
    for text in ("", "one", "One two", "a b c d e f g h i j k l", "averylongword and some,more-words É ß x", " \n "):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
        found = list(resample.features(text.encode(), 3))
        assert sum(n for n, _ in found) == len(w)
        for k in range(3):
            assert Counter(x for _, runs in found for x in runs[k]) == Counter(zlib.crc32(" ".join(w[i : i + k + 1]).encode()) for i in range(len(w) - k))


def test_resample(spark, docs):  # noqa: F811
    target = spark.createDataFrame([("lon rave mite",), (None,), ("",)], "text string")
    params = resample.ResampleParams(least_words=5, percent=40)
    made = docs.withColumns({"n": F.lit("x"), "score": F.lit(1), "part": F.lit(2)})
    for wanted in (target, target.limit(0)):
        found = resample.resampled(made, wanted, carry=["text"], params=params).collect()
        assert len(found) == docs.count()
        drawn = sorted((r.rank, r) for r in found if r.rank is not None)
        able = [r for r in found if r.n_words >= 5]
        assert [k for k, _ in drawn] == list(range(1, 40 * len(able) // 100 + 1))
        order = sorted(able, key=lambda r: (-r.score, r.doc_id is None, r.doc_id or 0))
        assert [(r.score, r.doc_id) for _, r in drawn] == [(r.score, r.doc_id) for r in order[: len(drawn)]]
        for r in found:
            h = int(hashlib.sha256(f"42:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
            assert r.score - r.weight == math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            n = len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(r.row.text)))
            assert (r.n_words, r.n_features) == (n, sum(max(n - k, 0) for k in range(3)))
            assert r.weight == 0 or n
    got = resample.draw(made, target, params=params)
    assert got.columns == made.columns and got.count() == len(drawn)
    assert resample.resampled(made.limit(0), target).count() == 0


def test_resample_draws_towards_the_target(spark):
    rng = random.Random(8)
    a, b = [f"aa{k}" for k in range(50)], [f"bb{k}" for k in range(50)]
    made = spark.createDataFrame([(k, " ".join(rng.choice(a if k % 4 else b) for _ in range(60))) for k in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([(" ".join(rng.choice(b) for _ in range(500)),)], "text string")
    drawn = resample.draw(made, target).collect()
    assert len(drawn) == 20 and all(r.doc_id % 4 == 0 for r in drawn)


def test_line_dedup_of_texts_of_many_lines(spark):
    from kerbside.llm import line_dedup

    lines = [" ".join(f"w{k}x{j}" for j in range(10)) for k in range(20_000)]
    near = [x.replace("x9", "y") for x in lines]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join([*near, "quite another line"]))], "doc_id long, text string")  # noqa: F811
    found = {r.row.doc_id: r for r in line_dedup.deduplicated(docs).collect()}
    assert (found[1].n_lines, found[1].n_removed, found[1].kept_text) == (20_000, 0, "\n".join(lines))
    assert (found[2].n_lines, found[2].n_removed, found[2].kept_text) == (20_001, 20_000, "quite another line")


def test_near_dedup_of_one_template_makes_few_pairs(spark, monkeypatch):
    """Texts that share most of their shingles, but too few, with near copies among them: pairs to verify stay in proportion to texts."""
    from kerbside.llm import minhash

    rng = random.Random(4)
    common = [f"c{k}" for k in range(152)]
    made = [(k, " ".join([*common, *(f"u{k}x{j}" for j in range(rng.randint(48, 54)))])) for k in range(300)]
    made += [(1000 + k, made[7 * k][1].replace(f"u{7 * k}x3", "other")) for k in range(20)]
    docs, pairs = spark.createDataFrame(made, "doc_id long, text string"), []  # noqa: F811
    verified = minhash.verified
    monkeypatch.setattr(minhash, "verified", lambda p, s: (pairs.append(p.count()), verified(p, s))[1])
    found = {r.doc_id: r.component_id for r in minhash.similar(docs).collect()}
    sets = {k: {" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in made}
    assert 0.55 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.65
    assert found == {k: 7 * (k - 1000) if k >= 1000 else k for k, _ in made}
    assert sum(pairs) < 10 * len(made)


def test_prefix_join_finds_every_similar_pair(spark):
    from kerbside.llm import minhash

    rng = random.Random(9)
    sets = [sorted(rng.sample(range(-60, 60), rng.randint(1, 40))) for _ in range(30)]
    for s in list(sets):
        for _ in range(4):
            sets.append(sorted(set(rng.sample(s, max(1, len(s) - rng.randint(0, 5)))) | {rng.randint(-60, 60) for _ in range(rng.randint(0, 4))}))
    made = spark.createDataFrame(list(enumerate(sets)), "node long, found array<long>")
    pairs = {(r.a, r.b) for r in minhash.verified(minhash.prefix_join(made, made.select("node", F.col("node").alias("root"))), made).collect()}
    near = {(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(set(sets[a]) & set(sets[b])) >= 4 * len(set(sets[a]) | set(sets[b]))}
    assert near and pairs == near


def test_decontamination_has_one_worker_a_task_for_any_number_of_shards(spark, tmp_path):
    """A benchmark of many shards: no job's plan has more than one Python node, and rows are those of one shard (but for longest, which a piece of an item bounds)."""
    from kerbside.llm import decontaminate

    rng = random.Random(2)
    items = [(k, " ".join(f"i{rng.randint(0, 40)}" for _ in range(60))) for k in range(40)]
    texts = [(k, " ".join([*items[k % 40][1].split()[k % 20 : k % 20 + 16], *(f"t{j}" for j in range(k))])) for k in range(60)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")  # noqa: F811
    known = ["n_words", "n_hit", "spans", "item_ids", "contaminated"]
    one, many = (decontaminate.matched(docs, bench, limits=decontaminate.Limits(max_words=m)) for m in (10_000, 200))
    read = lambda df: sorted((r.row.doc_id, *[r[c] for c in known]) for r in df.collect())
    assert read(one) == read(many) and one.filter("contaminated").count() > 30
    assert many._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_line_dedup_looks_again_only_where_other_candidates_are(spark, monkeypatch):
    """Lines a little too far apart whose signatures are near: a pair that shares several tokens is one candidate, and settled by one look."""
    from kerbside.llm import line_dedup

    rng = random.Random(6)
    made = []
    for k in range(300):
        rare, often = [f"p{k}x{j}" for j in range(17)], rng.sample(range(40), 6)
        made += [" ".join([*rare, *(f"often{j}" for j in often[:3])]), " ".join([*rare, *(f"often{j}" for j in often[3:])])]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")  # noqa: F811
    names, written = [], line_dedup.materialise
    monkeypatch.setattr(line_dedup, "materialise", lambda df, name: (names.append(name), written(df, name))[1])
    found = line_dedup.deduplicated(docs).collect()
    assert len(found) == 600 and sum(r.n_removed for r in found) == 0
    assert "lines-nearest" in names and "lines-others" not in names


def test_line_dedup_packed_rarity(spark):
    from kerbside.llm import line_dedup

    levels = line_dedup.rarity(spark.createDataFrame([("often " * 1000 + "seldom",), (None,)], "text string"))  # noqa: F811
    a, b = spark.sql("select xxhash64('often'), xxhash64('seldom')").first()
    assert [levels[(h & (line_dedup.BUCKETS - 1)) // line_dedup.PACKED] >> 4 * (h % line_dedup.PACKED) & 15 for h in (a, b)] == [15, 6]
    assert len(levels) == line_dedup.BUCKETS // line_dedup.PACKED
    assert set(line_dedup.rarity(spark.createDataFrame([], "text string"))) == {0}
