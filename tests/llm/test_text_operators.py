"""Deduplication, joins, packing and encoding against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import bpe, ngram_join, packing, suffix_dedup

PATH = public_tokenizers.path("byte_bpe_50k.json")


def mixed(spark, docs, n=150):
    few = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(f"doc_id < {n}").selectExpr("doc_id + 100 doc_id", "text")
    return docs.select("doc_id", "text").union(few)


def brute_repeats(rows, span=100):
    seen, out = set(), {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        covered = bytearray(len(b))
        for i in range(len(b) - span + 1):
            w = b[i : i + span]
            if w in seen:
                covered[i : i + span] = b"\x01" * span
            else:
                seen.add(w)
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        out[d] = (len(b), len(b) - len(kept), len(re.findall(b"\x01+", bytes(covered))), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark, docs):
    df = mixed(spark, docs)
    want = brute_repeats([(r.doc_id, r.text) for r in df.collect()])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got.pop(None)[1] == 0
    assert got == want


def test_repeats_of_nothing(spark, docs):
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_a_copy_ahead_of_the_first(spark):
    """One partition meets a copy before the document of least id, which shares a passage and repeats itself."""
    rng = np.random.default_rng(9)
    long, shared, other = ("".join(map(chr, rng.integers(97, 123, k))) for k in (400, 200, 300))
    rows = [(5, long + shared + long), (3, long + shared + long), (9, other + shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(rows)
    assert got[3][1] == 400 and got[9][1] == 200


def by_brute_force(spark, rows, order):
    df = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(rows)
    return got


def test_any_order_of_rows(spark):
    """Passages in many documents, at their begins and ends too, and copies: shuffled and in descending order."""
    rng = np.random.default_rng(11)
    word = lambda k: "".join(map(chr, rng.integers(97, 123, k)))
    passages = [word(k) for k in (100, 101, 150, 400)]
    rows = [(d, word(int(rng.integers(0, 150))) + "".join(passages[k] + word(int(rng.integers(0, 40))) for k in rng.integers(0, 4, rng.integers(0, 4)))) for d in range(60)]
    rows += [(100 + d, rows[d][1]) for d in range(0, 60, 7)] + [(-5, rows[9][1])]
    for order in (rng.permutation(len(rows)), sorted(range(len(rows)), key=lambda i: -rows[i][0])):
        assert sum(x[1] > 0 for x in by_brute_force(spark, rows, order).values()) > 20


def test_anchors_that_recur_without_a_repeat(spark):
    """Phrases of 60 bytes in several documents make candidates, but no string of 100 bytes stands there twice."""
    rng = np.random.default_rng(13)
    phrase = "".join(map(chr, rng.integers(97, 123, 60)))
    rows = [(d, "".join(map(chr, rng.integers(97, 123, 80))) + phrase + "".join(map(chr, rng.integers(97, 123, 80)))) for d in range(4)]
    assert all(x[1] == 0 for x in by_brute_force(spark, rows, range(4)).values())


def test_repeated_ids(spark):
    """The same row twice is one document; an id with two texts takes no part."""
    rng = np.random.default_rng(17)
    t, u = ("".join(map(chr, rng.integers(97, 123, 300))) for _ in range(2))
    df = spark.createDataFrame([(3, t), (3, t), (5, u), (5, t), (5, "short"), (7, "x" + t), (9, t), (9, t)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [(3, 300, 0), (3, 300, 0), (5, 5, 0), (5, 300, 0), (5, 300, 0), (7, 301, 300), (9, 300, 300), (9, 300, 300)]


def test_columnwise_windows():
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 99, (300, 24)).astype(np.uint8)
    rows[200:] = rows[rng.integers(0, 200, 100)]
    valid = rng.random((300, 9)) < 0.8
    got = suffix_dedup.equal_windows(rows, 16, valid)
    for c in range(9):
        first = {}
        for i in range(300):
            w = rows[i, c : c + 16].tobytes()
            assert got[i, c] == (valid[i, c] and w in first)
            if valid[i, c]:
                first.setdefault(w, i)


def brute_groups(rows, k=5, percent=80):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d for d in sets if d is not None)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), None if d is None else top(d)) for d, s in sets.items()}


def brute_links(rows, k=5, percent=80):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    real = {d: s for d, s in sets.items() if s and d is not None}
    return {d: sum(e != d and 100 * len(s & x) >= percent * len(s | x) for e, x in real.items()) if d in real else 0 for d, s in sets.items()}


def test_groups(spark, docs):
    chain = spark.range(40).selectExpr("id + 1000 doc_id", "concat_ws(' ', transform(sequence(id, id + 60), x -> concat('w', x))) text")
    df = mixed(spark, docs).union(chain)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    found = ngram_join.similar_groups(df, links=True).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found}
    assert got == brute_groups(rows)
    assert got[1010][1] == 1000
    assert {r.doc_id: r.n_links for r in found} == brute_links(rows)


def test_links_of_groups_in_many_blocks(spark, monkeypatch):
    """A group of many near copies, some of them exact, in blocks of a few sets; an id that is there twice is one."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    rng = np.random.default_rng(29)
    text = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(60):
        mine = list(text)
        for i in rng.integers(0, 200, int(rng.integers(0, 6))):
            mine[i] = f"v{rng.integers(0, 9)}"
        rows.append((d, " ".join(mine)))
    rows += [(100 + d, rows[d][1]) for d in range(0, 60, 9)]
    df = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string").repartition(3)
    found = ngram_join.similar_groups(df, links=True)
    want = brute_links(rows)
    assert {r.doc_id: r.n_links for r in found.collect()} == want
    assert len(set(want.values())) > 10


def test_near_copies_of_a_text(spark):
    """Variants that are far from each other and near to one text, which isn't the first."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(60):
        w = list(base)
        for at in rng.choice(200, 4, replace=False):
            w[at] = f"x{d}_{at}"
        rows.append((d, " ".join(w)))
    rows.append((60, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(df).collect()}
    assert got == brute_groups(rows)


def test_long_sets_around_the_doublings(spark):
    """Sets of 2,000 to 5,000 shingles with a shared passage; copies with changes just below and above what links."""
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(1500)]
    rows = []
    for size in (2040, 2052, 2600, 4090, 4100, 5000):
        own = passage + [f"v{rng.integers(1 << 40)}" for _ in range(size - 1500)]
        rows.append((len(rows), " ".join(own)))
        for share in (0.01, 0.019, 0.0215, 0.0225, 0.024, 0.03):
            w = list(own)
            for at in rng.choice(size, int(size * share), replace=False):
                w[at] = f"x{rng.integers(1 << 40)}"
            rows.append((len(rows), " ".join(w)))
        rows.append((len(rows), " ".join(own + [f"y{rng.integers(1 << 40)}" for _ in range(size // 5)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(df).collect()}
    want = brute_groups(rows)
    assert got == want
    assert 6 < len({c for _, c in want.values()}) < len(rows)


def test_groups_of_nothing(spark, docs):
    assert ngram_join.similar_groups(docs.limit(0)).count() == 0


def test_encoding(spark, docs):
    df = mixed(spark, docs)
    t = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in bpe.encode_decode(df, PATH, with_ids=True).collect()}
    for r in df.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        g = got[r.doc_id]
        assert g.ids == ids and g.n_tokens == len(ids) and g.decoded == t.decode(ids, skip_special_tokens=False)
        assert g.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode_decode(docs.limit(0), PATH).count() == 0


def test_encoding_of_odd_strings():
    import random

    r, c, t = random.Random(2), bpe.Codec(PATH), Tokenizer.from_file(PATH)
    parts = ["a", "The", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "’", "é", "中", "\xa0", "\x85", "\x1c", "!", "12", "<|endoftext|>", "à ", "🙂", "\r\n", " ", "'T", "_", "\x00"]
    for _ in range(5000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert c.ids(s).tolist() == t.encode(s, add_special_tokens=False).ids


def test_packing(spark, docs):
    df = mixed(spark, docs)
    rows = packing.pack(df, PATH).collect()
    t, by_doc, by_seq = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for r in df.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[r.doc_id], key=lambda p: p.piece)
        assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]] and sum(p.length for p in pieces) == len(ids)
        assert all(p.length == 2048 for p in pieces[1:])
        import zlib

        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in pieces)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_seq) == -(-sum(r.length for r in rows) // 2048)
    assert packing.pack(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("sizes", [[6, 5, 5, 4, 4, 3, 3], [7, 6, 4, 3], [10] * 3, [1] * 25, [9, 8, 2, 1], [5, 5, 5, 4, 4, 4, 2]])
def test_bin_completion_is_optimal_on_small_cases(sizes):
    def least(left, bins):
        if not left:
            return len(bins)
        best = len(left) + len(bins)
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] >= left[0]:
                best = min(best, least(left[1:], [*bins[:i], bins[i] - left[0], *bins[i + 1 :]]))
        return min(best, least(left[1:], [*bins, 10 - left[0]]))

    counts = np.bincount(sizes, minlength=11)
    plan = packing.complete_bins(counts, 10)
    assert sorted(x for f, n in plan for x in f * n) == sorted(sizes) and all(sum(f) <= 10 for f, _ in plan)
    assert packing.bins(plan) == least(sorted(sizes, reverse=True)[:8], []) if len(sizes) <= 8 else packing.bins(plan) == -(-sum(sizes) // 10)
