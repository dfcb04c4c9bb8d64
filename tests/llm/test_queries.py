"""The registered queries and the pipeline's stages on the given tables, against SQL or brute force."""

import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

import corpus_pipeline
from kerbside.llm import oracles, ppm_model, queries
from tests.oracle import same

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def given(table, columns):
    return duckdb.connect().execute(f"select {columns} from '{SF}/{table}.parquet'").fetchall()


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rows(frame, *columns):
    return Counter(tuple(r) for r in frame.select(*columns).collect())


def grouped(linked, keys):
    """The smallest key reachable from each, over linked(i, k)."""
    root = list(range(len(keys)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(keys)):
        for k in range(i):
            if find(i) != find(k) and linked(i, k):
                root[find(i)] = find(k)
    least = {}
    for k, key in enumerate(keys):
        least[find(k)] = min(key, least.get(find(k), key))
    return [least[find(k)] for k in range(len(keys))]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    same(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_op3_rules_on_the_given_pages(spark):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    found = {r.page_id: r for r in queries.op3_url_filter(spark, SF).collect()}
    pages = given("pages", "page_id, url")
    assert len(found) == len(pages)
    for key, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [r for r in rules if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (found[key].host, found[key].path, found[key].rule) == (host, path, rule)
        assert found[key].verdict == rules[rule] if rule else found[key].verdict in ("allow", "block")


def test_op5_on_the_given_pages(spark):
    pages, last, expected = given("pages", "page_id, html"), {}, Counter()
    for key, html in pages:
        last[html or ""] = max(last.get(html or "", key), key)
    for key, html in pages:
        b, to = (html or "").encode(), last[html or ""]
        expected[key, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to == key else "revisit", None if to == key else to] += 1
    assert rows(queries.op5_warc(spark, SF), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected


def test_op6_on_the_given_documents(spark):
    found = {r.doc_id: r for r in queries.op6_ppm(spark, SF).collect()}
    docs = [(k, lower(t)) for k, t in given("documents", "doc_id, text")]
    assert len(found) == len(docs)
    out = {k for k, _ in docs if zlib.crc32(str(k).encode()) % 7 == 2}
    counts = Counter(w for k, t in docs if k not in out for w in [*WORD.findall(t), None])
    n, v = sum(counts.values()), len(counts)
    grams = ppm_model.text_grams([t.encode() for k, t in docs if k not in out], 5)[0]
    plain = ppm_model.Model([ppm_model.counted(grams & ((1 << 8 * (k + 1)) - 1)) for k in range(6)]).score([t.encode() for _, t in docs])
    for (k, t), score in zip(docs, plain):
        words, r = [*WORD.findall(t), None], found[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (k in out, len(words), sum(w in counts for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10(counts[w] + 1) for w in words) - len(words) * math.log10(n + v + 1), rel_tol=1e-9)
        assert math.isclose(r.score, score, rel_tol=1e-5)


def test_op7_on_the_given_documents(spark):
    docs, fps = sorted(given("documents", "doc_id, text")), []
    for _, t in docs:
        words = WORD.findall(lower(t))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    least = grouped(lambda i, k: (fps[i] ^ fps[k]).bit_count() <= 3, [k for k, _ in docs])
    assert rows(queries.op7_simhash(spark, SF), "doc_id", "fingerprint", "component_id") == Counter((k, f"{fp:016x}", c) for (k, _), fp, c in zip(docs, fps, least))


def packed_as(found, docs):
    from tokenizers import Tokenizer

    tok, expected, total = Tokenizer.from_file(queries.public_tokenizer("word_bpe_49k.json")), Counter(), 0
    for k, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        for p, a in enumerate(range(0, len(ids), 4096)):
            x = ids[a : a + 4096]
            expected[k, p, a, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))] += 1
    assert rows(found, "doc_id", "piece", "start", "length", "ids_crc32") == expected
    bins = defaultdict(list)
    for r in found.collect():
        bins[r.sequence_id].append((r.offset, r.length))
    for one in bins.values():
        at = 0
        for offset, length in sorted(one):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= 1.02 * total / 4096 + 2


def test_op8_on_the_given_documents(spark):
    packed_as(queries.op8_packing(spark, SF), given("documents", "doc_id, text"))


def without_repeats(docs):
    """Documents (id, text) without lines that repeat an earlier one at a Jaccard of 0.8, nor those left without words."""
    seen, kept = [], []
    for k, t in sorted(docs, key=lambda r: r[0]):
        lines = []
        for x in (t or "").split("\n"):
            s = frozenset(WORD.findall(x))
            if not s or not any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                lines.append(x)
            if s:
                seen.append(s)
        text = "\n".join(lines)
        if text == (t or "") or WORD.search(text):
            kept.append((k, text if t is not None else None))
    return kept


def first_of_similar(docs):
    def shingles(t):
        w = lower(t).split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    docs = sorted(docs)
    sets = [shingles(t) for _, t in docs]
    near = lambda i, k: 5 * len(sets[i] & sets[k]) >= 4 * len(sets[i] | sets[k])
    return [d for d, c in zip(docs, grouped(near, [k for k, _ in docs])) if c == d[0]]


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con, stages = duckdb.connect(), dict(corpus_pipeline.STAGES)
    con.execute(f"create view benchmark as select * from '{SF}/benchmark.parquet'")

    def by_sql(sql, condition, frame):
        con.register("documents", frame.toPandas())
        keys = {r[0] for r in con.execute(f"select doc_id from ({sql}) where {condition}").fetchall()}
        con.unregister("documents")
        return keys

    def after(name, frame):
        found = stages[name](spark, frame, SF)
        assert found.columns == docs.columns
        return spark.createDataFrame(found.collect(), docs.schema)

    good = after("quality", docs)
    assert {r.doc_id for r in good.collect()} == by_sql(oracles.OP9, "kept", docs) and good.exceptAll(docs).count() == 0
    lines = after("line_dedup", good)
    assert rows(lines, "doc_id", "text") == Counter(without_repeats([(r.doc_id, r.text) for r in good.collect()]))
    once = after("near_dedup", lines)
    assert rows(once, "doc_id", "text") == Counter(first_of_similar([(r.doc_id, r.text) for r in lines.collect()]))
    clean = after("decontaminate", once)
    assert {r.doc_id for r in clean.collect()} == by_sql(oracles.OP1, "not contaminated", once) and clean.exceptAll(once).count() == 0
    assert clean.count() < docs.count()
    packed_as(stages["packing"](spark, clean, SF), [(r.doc_id, r.text) for r in clean.collect()])


def test_pipeline_stages_take_odd_rows(spark):
    text = " ".join(f"word{k}" for k in range(40))
    made = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, None), (4, ""), (5, "\n\n"), (6, " ".join(f"long{k}" for k in range(60_000)))]
    docs = spark.createDataFrame([(k, t, "en", None if k == 2 else "s", len(t or ""), 1, "x") for k, t in made], "doc_id long, text string, lang string, source string, n_chars long, id int, row string")
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, now, SF)
            assert found.columns == docs.columns
            now = spark.createDataFrame(found.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() >= now.count()
        assert {r.doc_id for r in now.collect()} == (set() if start is not docs else {None, 6})


def test_op13_on_the_given_documents(spark):
    docs, bench = given("documents", "doc_id, text"), given("benchmark", "text")

    def sums(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    found = {k: sums(t) for k, t in docs}
    s, t = Counter(b for _, x in found.values() for b in x), Counter(b for (x,) in bench for b in sums(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(float((t[b] + 1) * (total_s + 10000)) / float((s[b] + 1) * (total_t + 10000)))) for b in range(10000)]
    expected, able = {}, []
    for k, (n, x) in found.items():
        h = int(hashlib.sha256(f"42:{k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        expected[k] = [k, len(x), weight, score, None]
        if n >= 20:
            able.append((-score, k))
    for rank, (_, k) in enumerate(sorted(able)[: 5 * len(able) // 100], 1):
        expected[k][4] = rank
    assert rows(queries.op13_resample(spark, SF), "doc_id", "n_features", "weight", "score", "rank") == Counter(map(tuple, expected.values()))
