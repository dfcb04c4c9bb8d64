"""The operators against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import itertools
import math
import random
import re
import struct
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from kerbside.llm import blocks, chat, decontaminate, line_dedup, packing, ppm, quality, queries, simhash, substring, url_filter, warc

SPACE = "[^\x20\x09-\x0d]+"
WORDS = [a + b for a in ("lo", "ra", "mi", "te", "Ko", "É") for b in ("n", "sti", "ve", "qu", "d.", "x,", "ß")]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def prose(rng, n, per_line=9):
    return "".join(rng.choice(WORDS) + ("\n" if i % per_line == per_line - 1 else " ") for i in range(n))


def texts():
    rng = random.Random(11)
    base = prose(rng, 120)
    near = base.replace("lon", "rave", 1)
    repeated = "\n".join(["one two three four five six seven eight nine ten"] * 6)
    shared = " ".join(rng.choice(WORDS) for _ in range(45))
    out = [None, "", " \t\n ", "x", "A B", base, base, near, repeated, prose(rng, 30) + shared, shared + " " + prose(rng, 25), prose(rng, 6000), "<s> #| $ </s>", "\u2003wide\u00a0space"]
    return out + [prose(rng, rng.randint(1, 60)) for _ in range(20)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "no id at all here"), (None, None), (5, texts()[5]), (7, "another text under one id")]
    made = [(k, t, "en", f"src{(k or 0) % 3}" if k != 9 else None, len(t or ""), 1, "x", 2, "y") for k, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, id long, row string, block int, h string").repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def counted(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_simhash(docs, rows):
    def fp(t):
        w = re.findall(SPACE, lower(t))
        if not w:
            return 0
        h = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                group[root(i)] = root(j)
    low = defaultdict(lambda: None)
    for i, (k, _) in enumerate(rows):
        if k is not None and (low[root(i)] is None or k < low[root(i)]):
            low[root(i)] = k
    expected = Counter((k, f"{f:016x}", low[root(i)]) for i, ((k, _), f) in enumerate(zip(rows, fps)))
    assert counted(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == expected
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert counted(kept, "doc_id") == Counter((k,) for i, (k, _) in enumerate(rows) if k is None or not low[root(i)] < k)


def test_simhash_forest_and_masks():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(1 << k) for k in range(0, 60, 7)]))
    found = {frozenset(x.tolist()) for x in simhash.forest(fps, 3)}
    assert sum(map(len, found)) == len(fps) and len(found) == 40
    masks = simhash.block_masks(6, 3)
    for _ in range(200):
        a = rng.integers(0, 1 << 63)
        b = a
        for bit in rng.choice(63, 3, replace=False):
            b ^= 1 << int(bit)
        assert any(int(a) & m == int(b) & m for m in masks)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(101, 100)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_near_dedup_stage_against_brute_force(spark):
    import corpus_pipeline

    rng = random.Random(8)
    draw = lambda: f"w{rng.randrange(5000)}"
    made = []
    for k in range(40):
        base = [draw() for _ in range(200)]
        made.append(" ".join(base))
        for n in (1, 2, 3, 4, 5, 7, 9):
            w = list(base)
            for at in rng.sample(range(200), n):
                w[at] = draw()
            made.append(" ".join(w))
    chain = [draw() for _ in range(300)]
    made += [" ".join(chain[k * 8 : k * 8 + 180]) for k in range(15)] + [None, "", "one two", "One  two", "one three", made[0].upper()]
    rng.shuffle(made)
    sets = []
    for t in made:
        w = re.findall(SPACE, lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(made)))
    near = 0
    for i in range(len(made)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                near += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert near > 200
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert counted(kept, "doc_id") == Counter((k,) for k in range(len(made)) if root[k] == k)


def test_decontaminate(spark, docs, rows):
    lookup = dict(rows)
    w11 = re.findall(SPACE, lookup[11])
    items = [(1, " ".join(w11[50:80])), (2, "x"), (2, "x"), (3, None), (4, "!!"), (None, " ".join(w11[200:216])), (10, "one two three"), (6, lookup[5])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for k, t in items:
        w = word.findall(lower(t))
        for s in [w] if 0 < len(w) < 13 else [w[i : i + 13] for i in range(len(w) - 12)]:
            windows[tuple(s)].add(k)
    expected = Counter()
    for k, t in rows:
        w = word.findall(lower(t))
        hit, ids = [0] * len(w), set()
        for n in {len(s) for s in windows}:
            for i in range(len(w) - n + 1):
                if (s := tuple(w[i : i + n])) in windows:
                    ids |= windows[s]
                    hit[i : i + n] = [1] * n
        n = sum(hit)
        expected[k, len(w), n, ",".join(sorted(str(x) for x in ids if x is not None)), n > 0 and 20 * n >= len(w)] += 1
    for most in (200_000, 20):
        found = decontaminate.matched(docs, bench, limits=decontaminate.Limits(max_words=most), cut_text=True)
        flat = found.select("row.doc_id", "n_words", "n_hit", F.array_join("item_ids", ",").alias("ids"), "contaminated")
        assert counted(flat, *flat.columns) == expected
    cut = {r.row.doc_id: r.cut for r in found.collect() if r.row.doc_id is not None}
    assert cut[3] == "" and "one two three" not in cut[8] and cut[12] == lookup[12]
    long = decontaminate.matched(docs, bench, limits=decontaminate.Limits(span_words=20), cut_text=True)
    one = next(r for r in long.collect() if r.row.doc_id == 11)
    assert not one.contaminated and re.findall(SPACE, one.cut) == w11[:50] + w11[80:] and cut[11] == lookup[11]
    assert decontaminate.clean_documents(docs, bench).columns == docs.columns
    none = decontaminate.matched(docs, bench.limit(0))
    assert none.filter("contaminated or n_hit > 0").count() == 0


@pytest.fixture(params=[4096, 4, 2], ids=["one level", "two levels", "many groups"])
def levels(request, monkeypatch):
    """Blocks in one group, in two, and in four whose keys all go through one coarse bucket."""
    monkeypatch.setattr(blocks, "GROUP_BLOCKS", request.param)


def test_substring(docs, rows, levels):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    seen, expected = set(), Counter()
    for k, t in order:
        w = re.findall(SPACE, t or "")
        gone = [0] * len(w)
        for i in range(len(w) - 19):
            s = tuple(w[i : i + 20])
            if s in seen:
                gone[i : i + 20] = [1] * 20
            seen.add(s)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        expected[k, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    found = substring.removed(docs)
    assert counted(found, "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text") == expected
    assert sum(c for (_, _, n, _, _), c in expected.items() if n) >= 4


def test_ppm_words_and_normalisation(docs, rows, levels):
    end, params = object(), ppm.PpmParams(order=3)
    tokens = [(k, re.findall(SPACE, lower(t)) + [end]) for k, t in rows]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    c = Counter(w for k, t in tokens if not held(k) for w in t)
    n, v = sum(c.values()), len(c)
    expected = Counter((k, held(k), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for k, t in tokens)
    found = ppm.scored(docs, params=params)
    flat = found.withColumn("base", F.round("base_score", 6))
    assert counted(flat, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base") == expected
    assert all(r.score < 0 for r in found.collect())


def test_ppm_scores_use_every_gram(docs, rows, levels):
    import dataclasses

    # whatever limit of the model's size there is would be passed by far
    limits = {f.name: 50 for f in dataclasses.fields(ppm.PpmParams) if f.name.startswith("max_")}
    counts = [defaultdict(Counter) for _ in range(4)]
    framed = [(k, b"\xff" * 3 + lower(t).encode() + b"\xff") for k, t in rows]
    for k, b in framed:
        if k is None or zlib.crc32(str(k).encode()) % 7 != 2:
            for i in range(3, len(b)):
                for n in range(4):
                    counts[n][b[i - n : i]][b[i]] += 1

    def log10(ctx, s):
        out, excluded = 0.0, set()
        for n in (3, 2, 1, 0):
            if not (every := counts[n].get(ctx[3 - n :])):
                continue
            have = {x: c for x, c in every.items() if x not in excluded}
            if s in have:
                return out + math.log10(have[s] / (sum(have.values()) + len(have)))
            if have:
                out += math.log10(len(have) / (sum(have.values()) + len(have)))
            excluded |= set(have)
        return out - math.log10(256 - len(excluded))

    expected = sorted((k is not None, k or 0, round(sum(log10(b[i - 3 : i], b[i]) for i in range(3, len(b))), 2)) for k, b in framed)
    found = sorted((r.doc_id is not None, r.doc_id or 0, r.score) for r in ppm.scored(docs, params=ppm.PpmParams(order=3, **limits)).collect())
    assert [x[:2] for x in found] == [x[:2] for x in expected]
    assert all(abs(a[2] - b[2]) < 0.01 for a, b in zip(found, expected))


def test_blocks_are_ranges_of_ids_at_both_levels(spark, monkeypatch):
    """An id that half of all rows share, rows without an id, and groups cut again into blocks."""
    rows = [(None, f"none {i % 3}") for i in range(40)] + [(500, f"hot {i % 50}") for i in range(300)] + [(i, f"text {i}") for i in range(300, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for limit in (4096, 4, 3, 2):
        monkeypatch.setattr(blocks, "GROUP_BLOCKS", limit)
        deal = blocks.Deal(docs, "text")
        found = [(deal.block_index(r.block), r.id, r.text) for r in blocks.dealt(docs, deal, "doc_id", "text").collect()]
        assert Counter((k, t) for _, k, t in found) == Counter(rows)
        held = defaultdict(set)
        for b, k, t in found:
            held[k if k is not None else -1, t].add(b)
        assert all(len(b) == 1 for b in held.values())  # equal rows are in one block
        spans = defaultdict(list)
        for b, k, _ in found:
            spans[b].append(-1 if k is None else k)
        ordered = [spans[b] for b in sorted(spans)]
        assert all(max(x) <= min(y) for x, y in zip(ordered, ordered[1:]))
        # a range holds at most two fair shares, at either level
        assert max(map(len, ordered)) <= (2 if deal.groups == 1 else 4) * 1.2 * len(rows) / (deal.groups * deal.per_group)


def test_blobs_do_not_grow_with_the_square(spark, monkeypatch):
    """With blocks in groups, a block sends to the coarse buckets only and a group's bucket to its fine ones only."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(200))) for i in range(200)], "doc_id long, text string")
    sent = []
    answered = blocks.answered
    monkeypatch.setattr(blocks, "answered", lambda s, deal, settle, merge, *rest: sent.extend([(deal, s, s.groupBy("bucket").applyInArrow(merge, s.schema))]) or answered(s, deal, settle, merge, *rest))
    monkeypatch.setattr(blocks, "GROUP_BLOCKS", 8)
    monkeypatch.setattr(blocks, "shuffle_partitions", lambda _: 32)
    assert substring.removed(docs).filter("n_removed > 0").count() == 0
    deal, first, second = sent[0]
    assert (deal.groups, deal.per_group, deal.coarse, deal.fine) == (8, 8, 4, 8)
    assert first.count() <= 64 * 4 and second.count() <= 8 * 32 and second.select("bucket").distinct().count() == 32


def test_ppm_probabilities_sum_to_one_and_equal_a_plain_model():
    import numpy as np

    from kerbside.llm.ppm_model import Model, counted as count, text_grams

    seen = [b"abracadabra", b"abrakebabra", b"", b"banana"]
    top = count(text_grams(seen, 3)[0])
    tables = [top]
    for k in (2, 1, 0):
        tables.insert(0, count(tables[0][0] & ((1 << 8 * (k + 1)) - 1), tables[0][1]))
    model = Model(tables)
    counts = [Counter() for _ in range(4)]
    for t in seen:
        b = b"\xff" * 3 + t + b"\xff"
        for i in range(3, len(b)):
            for k in range(4):
                counts[k][b[i - k : i], b[i]] += 1

    def plain(ctx, s):
        out, excluded = 1.0, set()
        for k in (3, 2, 1, 0):
            have = {x: n for (c, x), n in counts[k].items() if c == ctx[3 - k :] and x not in excluded}
            if not any(c == ctx[3 - k :] for c, _ in counts[k]):
                continue
            total = sum(have.values()) + len(have)
            if s in have:
                return out * have[s] / total
            if have:
                out *= len(have) / total
            excluded |= set(have)
        return out / (256 - len(excluded))

    for ctx in (b"abr", b"bra", b"xyz", b"\xff\xffb", b"aba", b"nan"):
        codes = np.array([int.from_bytes(ctx, "big") << 8 | s for s in range(256)], np.int64)
        p = 10 ** model.log10(codes)
        assert abs(p.sum() - 1) < 1e-5
        assert np.allclose(p, [plain(ctx, s) for s in range(256)], rtol=1e-5)


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    path = queries.public_tokenizer("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    found = packing.pack(docs, path, 256).toPandas()
    expected = Counter()
    for k, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for p, a in enumerate(range(0, len(ids), 256)):
            x = ids[a : a + 256]
            expected[k, p, a, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))] += 1
    got = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found.itertuples())
    assert got == expected
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256


def test_plan_places_every_length_once():
    rng = random.Random(2)
    for draw in (lambda: rng.randint(1, 4096), lambda: min(4096, int(rng.expovariate(1 / 600)) + 1), lambda: rng.choice([1366, 2049, 700]), lambda: 4096):
        counts = Counter(draw() for _ in range(4000))
        places = packing.plan(counts)
        ranks, bins = defaultdict(list), defaultdict(list)
        for length, rank, n, first, offset in places:
            ranks[length] += range(rank, rank + n)
            for i in range(n):
                bins[first + i].append((offset, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(bins) <= 1.2 * max(sum(k * n for k, n in counts.items()) / 4096, sum(n for k, n in counts.items() if k > 2048)) + 1
    assert packing.plan({}) == []


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.public_tokenizer("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), packing._Encoder(path)
    odd = ["It's 'sword'—don't. été, İstanbul. Å̸ ≯ á. «mot» x…. 12ab. ŉ. ǅ, ﬁ) 가.", "hello<|endoftext|>World <|ENDOFTEXT|> <|startoftext|>", "a'S. dog's'. é's. Σας. " + unicodedata.normalize("NFD", "été naïve."), "a b.　½. ²x. \U0001f600. a\u200db ①, Ⅷ.", "", " ", "...", "a.b,c;d"]
    for t in odd + [t or "" for t in texts()]:
        own.prepare([t.encode()])
        assert own.ids(t.encode()) == struct.pack(f"<{len(x := tok.encode(t, add_special_tokens=False).ids)}I", *x), t


def measured(t):
    t = t or ""
    w = re.findall(SPACE, t)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(SPACE, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, rows):
    found = quality.judged(docs)
    expected = Counter()
    for k, t in rows:
        m = measured(t)
        expected[k, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]] += 1
    flat = found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert counted(flat, *flat.columns) == expected
    assert found.filter("kept and base_failed").count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert counted(kept, "doc_id") == counted(found.filter("kept").select("row.doc_id"), "doc_id")


def test_bad_hosts_take_their_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(30))
    made = [(k, good if k % 10 == 0 else "too short", "bad") for k in range(200)] + [(1000 + k, good, f"fine{k % 5}") for k in range(200)]
    d = spark.createDataFrame(made, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.keep_good(d).collect()}
    assert kept == set(range(1000, 1200))
    rate = {r.host: r.rate for r in quality.host_rates(quality.measured(d).select(F.col("row.source").alias("host"), "base_failed")).collect()}
    assert 0.8 < rate["bad"] < 0.9 and 0 < rate["fine1"] < 0.1


def test_line_dedup(spark):
    rng = random.Random(4)
    line = lambda n: " ".join(f"t{rng.randint(0, 400)}" for _ in range(n))
    pool = [line(rng.randint(3, 30)) for _ in range(60)]

    def variant(x):
        w = x.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"t{rng.randint(0, 400)}"
        return " ".join(w)

    made = [(k, "\n".join(variant(rng.choice(pool)) if rng.random() < 0.7 else line(rng.randint(1, 25)) for _ in range(rng.randint(1, 8)))) for k in range(120)]
    made += [(600 + k, x) for k, x in enumerate(["t1 t2", "t2\tt1 t1", "t1", "t1\nt9 t8 t7\n \n\t", "t8 t7 t9 t6", "t6 t7 t8 t9 t5"])]
    long_line = [f"long{k}" for k in range(9000)]
    made += [(700, " ".join(long_line)), (701, "  ".join(reversed(long_line[:8000]))), (702, "\r".join(long_line[:7000]))]
    made += [(500, None), (501, ""), (502, "\n\n"), (None, pool[0] + "\nonly here alpha beta gamma delta"), (3, made[3][1])]
    docs = spark.createDataFrame([(k, t, 1, "z") for k, t in made], "doc_id long, text string, id int, doc string")
    first, reps, gone, seen = {}, [], defaultdict(set), {}
    for k, t in sorted(set(made), key=lambda r: (r[0] is not None, r[0] or 0)):
        for i, x in enumerate((t or "").split("\n")):
            s = frozenset(re.findall(SPACE, x))
            if not s:
                continue
            if s in first:
                gone[k].add(i)
            else:
                first[s] = (k, i)
                if any(5 * len(s & r) >= 4 * len(s | r) for r in reps):
                    gone[k].add(i)
                reps.append(s)
    expected = Counter()
    for k, t in made:
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k])
        expected[k, len((t or "").split("\n")), len(gone[k]), kept] += 1
    found = line_dedup.deduplicated(docs)
    flat = found.select("row.doc_id", "n_lines", "n_removed", "kept_text")
    assert counted(flat, *flat.columns) == expected
    assert sum(map(len, gone.values())) > 100
    shuffled = line_dedup.deduplicated(docs, params=line_dedup.LineParams(broadcast_rows=0, crowd=3, anchors=2))
    assert counted(shuffled.select("row.doc_id", "n_lines", "n_removed", "kept_text"), *flat.columns) == expected


def test_chat_round_trip(spark):
    marks = "</s>[INST] ok [/INST] [\\INST] <\\\\s> [TURN] [/SYS]\n"
    made = [(1, 1, "assistant", marks), (1, 0, "user", "hi"), (1, 2, "assistant", "again"), (1, 3, "user", None), (2, 0, "system", "be\nkind"), (2, 1, None, "who"), (2, 2, "to[INST]ol", "x" * 5000), (None, 0, "user", ""), (3, 0, "user", "a"), (3, 0, "user", "b"), (3, None, "assistant", "[")]
    made += [(4, k, role, "hi") for k, role in enumerate(["us\ner", "  user", "[SYS] x", "a%0Ab%25\n\n", "\n", " [/SYS]\n", "[INST]", "us\n", "er"])]
    d = spark.createDataFrame([(*r, 1) for r in made], "conv_id long, turn long, role string, text string, id int")
    done = chat.formatted(d)
    found = {r.conv_id: r for r in chat.read_back(done).collect()}
    for k in {r[0] for r in made}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in made if c == k))
        assert [(x.role, x.text) for x in found[k].turns] == [(r, t) for _, _, r, t in turns]
        assert found[k].loss_text == "".join(t for _, _, r, t in turns if r == "assistant")
    assert chat.formatted(d.limit(0)).count() == 0


def test_chat_blocks_and_spans_of_a_long_conversation(spark):
    rng = random.Random(5)
    made = [(1, k, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice(["", "a", "[TURN] </s>", "é" * 7, "😀b"])) for k in range(1500)]
    row = chat.formatted(spark.createDataFrame(made, "conv_id long, turn long, role string, text string")).first()
    plain = lambda t: re.sub(r"([<\[])(\\*)(/?(?:s>|INST\]|SYS\]|TURN\]))", r"\1\\\2\3", t)
    want, spans, marks = "", [], {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "tool": ("[SYS] tool\n", " [/SYS]")}
    for k, (_, _, role, text) in enumerate(made):
        last = made[k - 1][2] if k else None
        want += "[TURN]" if role == last else (marks[last][1] if last else "") + marks[role][0]
        if role == "assistant":
            spans.append((len(want), len(plain(text))))
        want += plain(text)
    assert row.formatted == want + marks[made[-1][2]][1]
    # Spark counts from 1
    assert [(x.start - 1, x.length) for x in row.loss_spans] == spans


@pytest.mark.parametrize("n", [1, 255, 256, 257, 513, 70_000])
def test_chat_running_sums(spark, n):
    got = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: (x % 7).cast("int")).alias("a")).select(chat.sums_before("a").alias("s")).first().s
    assert got == [0, *itertools.accumulate(k % 7 for k in range(1, n))]


def test_url_rules(spark):
    urls = ["http://A.Example.NET/en/1?x#y", "https://example.net/de/", "http://notnet/", "http://net", "http://net/", "http://b.example.com/de/7", "http://example.com/dex", "ftp://x.org/fr/2", "nothing", None, "http://", "x://é.net/ü?", "http://a.b/c#d?e"]
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    d = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(None, urls[0], "h")], "page_id long, url string, host string")
    labelled = spark.createDataFrame([(f"http://good{k}.com/a/{k}", 0) for k in range(40)] + [(f"http://bad-{k}.biz/a?x=1&y={k}", 1) for k in range(40)], "url string, bad int")
    found = {r.page_id: r for r in url_filter.judged(d.select("page_id", "url"), labelled).collect()}
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len) if fits else None
        assert (found[k].host, found[k].path, found[k].rule) == (host, path, rule)
        assert found[k].verdict == rules[rule] if rule else found[k].verdict in ("allow", "block")
    assert url_filter.judged(d.select("page_id", "url"), labelled.limit(0)).filter("rule is null and verdict = 'block'").count() == 0


def test_url_trees_learn(spark):
    made = [(f"http://site{k}.com/page/{k}", 0) for k in range(150)] + [(f"http://win-cash-{k}.biz/{k}{k}{k}?a={k}&b=2&c=3", 1) for k in range(150)]
    held = spark.createDataFrame([(k, f"http://other{k}.com/story/{k}") for k in range(30)] + [(100 + k, f"http://big-cash-{k}.biz/9{k}9?q=1&r=2&s={k}") for k in range(30)], "page_id long, url string")
    found = url_filter.judged(held, spark.createDataFrame(made, "url string, bad int")).collect()
    assert sum((r.verdict == "block") == (r.page_id >= 100) for r in found) >= 57


def test_warc_round_trip(spark):
    html = ["<p>é</p>", "", None, "same", "same", "same", "x" * 300_000, "a\r\n\r\nb", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc"]
    made = [(k, f"http://h/{k} ü", t) for k, t in enumerate(html)]
    made += [(5, "v", "B"), (5, "v", "C"), (9, "v", "same"), (12, "v", "C"), (12, "w", "C"), (12, None, "only"), (5, "v", "B")]  # repeated ids
    made += [(None, "u", "alone"), (None, "w", "alone"), (None, "w", "alone"), (None, None, "same"), (None, "x", None)]
    d = spark.createDataFrame([(*r, 1) for r in made], "page_id long, url string, html string, id int")
    for least in (0, 5):
        last = {}
        for k, _, t in made:
            last[t or ""] = max((x for x in (last.get(t or ""), k) if x is not None), default=None)
        expected = Counter()
        for k, _, t in made:
            b = (t or "").encode()
            to = last[t or ""] if len(b) >= least and last[t or ""] != k else None
            expected[k, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to is None else "revisit", to] += 1
        assert counted(warc.round_trip(d, least_bytes=least), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    path = queries.public_tokenizer("word_bpe_49k.json")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    results = [simhash.near_duplicates(none), decontaminate.matched(none, bench), substring.removed(none), ppm.scored(none), packing.pack(none, path), quality.judged(none), line_dedup.deduplicated(none), warc.round_trip(pages), url_filter.judged(pages.select("page_id", "url"), pages.select("url", F.lit(1).alias("bad")))]
    assert [r.count() for r in results] == [0] * len(results)


def test_encoder_equals_the_tokenizer_after_every_letter():
    from tokenizers import Tokenizer

    path = queries.public_tokenizer("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), packing._Encoder(path)
    chars = [chr(c) for c in range(0x80, 0x2FFFF) if unicodedata.category(chr(c))[0] in "LMN" and not 0x4E10 < c < 0x9F00 and not 0xAC10 < c < 0xD790 and not 0x17010 < c < 0x187F0 and not 0x20010 < c]
    rng = random.Random(8)
    made = [f"a{c}{rng.choice(packing.TAIL.decode())} {c}{rng.choice(packing.TAIL.decode())}x {c}." for c in chars]
    made += [f"{a}{chr(m)}{t} {a.lower()}{chr(m)}" for a in "AHTWYJI" for m in range(0x300, 0x370) for t in ("", ".", '"')]
    alphabet = "aHTİ'sd.,-\"<|> ̱̈ßक़ड़़क०½ﬁ가  #"
    made += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    own.prepare([t.encode() for t in made])
    expected = tok.encode_batch(made, add_special_tokens=False)
    wrong = [t for t, e in zip(made, expected) if own.ids(t.encode()) != struct.pack(f"<{len(e.ids)}I", *e.ids)]
    assert not wrong, wrong[:10]


def test_simhash_hot_keys_lose_no_link(spark):
    rng = random.Random(3)
    base, made = rng.getrandbits(64), set()
    while len(made) < 300:  # all share 40 bits and more
        fp = base
        for _ in range(rng.randint(0, 6)):
            fp ^= 1 << rng.randrange(24)
        made.add(fp)
    fps = sorted(made)
    distinct = spark.createDataFrame([(k, fp - (1 << 64) if fp >> 63 else fp) for k, fp in enumerate(fps)], "node long, fp long")
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(fps):
        for k, b in enumerate(fps[:i]):
            if (a ^ b).bit_count() <= 3:
                root[find(i)] = find(k)
    expected = {frozenset(k for k in range(len(fps)) if find(k) == r) for r in {find(k) for k in range(len(fps))}}
    found = defaultdict(set)
    for r in simhash.components(simhash.links(distinct, hot=5)).collect():
        found[r.root].add(r.node)
    assert {frozenset(x) for x in found.values()} == {x for x in expected if len(x) > 1}


def test_rows_of_one_id_fill_several_blocks(spark):
    rng = random.Random(6)
    own = [" ".join(rng.choice(WORDS) for _ in range(25)) + f" end{k}" for k in range(40)]
    made = [(key, own[k % 40]) for key in (5, None) for k in range(200)]
    d = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    found = substring.removed(d).collect()
    assert len(found) == 400
    kept = Counter((r.doc_id, r.kept_text) for r in found if r.n_removed == 0)
    assert {k for k, _ in kept} == {None} and set(kept.values()) == {1} and len(kept) == 40
    assert sum(r.n_removed == r.n_words for r in found) == 360
