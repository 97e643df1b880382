"""Language, URLs, search, rules, chat, scoring, components and the pipeline on small and odd inputs."""

import hashlib
import re
import unicodedata
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import chat, language_id, lm_score, quality, queries, topk, url_rules
from quire.llm._shared import Scratch
from quire.llm.components import components

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    found = queries.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out")
    assert held.filter("lang = lang_pred").count() / held.count() > 0.97
    assert found.filter("score < 0 or score > 1").count() == 0


def test_language_of_odd_texts(spark, docs):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert all(got[d] == ("und", 0.0) for d in (2, 3, 4, 5)) and got[10][0] == "es" and len(got) == 15
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(docs.filter("lang is null"))).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), language_id.fit(docs.limit(0))).count() == 0


def test_letters_are_of_letter_categories(spark, docs):
    signs = ["½ ²", "Ⅷ ١٢", "_ 12", "ª", "º", "é", "中", "\u0301"]
    want = {i: any(unicodedata.category(c)[0] == "L" for c in x) for i, x in enumerate(signs)}
    found = language_id.predict(spark.createDataFrame(list(enumerate(signs)), "doc_id long, text string"), language_id.fit(docs))
    assert {r.doc_id: r.lang_pred != "und" for r in found.collect()} == want


def test_tables_shrink_before_a_language_is_left_out():
    assert language_id.slots_for(4) == language_id.SLOTS and 512 < language_id.slots_for(7000) * 7000 <= language_id.ROOM


def plain_mixture(like, penalty=1.0, steps=12):
    """The shares of one text by plain loops: all languages, then the weakest out while that costs less than keeping it."""
    def settle(share):
        for _ in range(steps):
            new = [0.0] * len(share)
            for run in like:
                part = [s * np.exp(max(x - max(run), -60.0)) for s, x in zip(share, run, strict=True)]
                new = [n + p / max(sum(part), 1e-300) / len(like) for n, p in zip(new, part, strict=True)]
            moved = max(abs(a - b) for a, b in zip(new, share, strict=True))
            share = new
            if moved < 1e-3:
                break
        return share, sum(np.log(max(sum(s * np.exp(max(x - max(run), -60.0)) for s, x in zip(share, run, strict=True)), 1e-300)) for run in like)

    share, fit = settle([1 / len(like[0])] * len(like[0]))
    while sum(s > 0 for s in share) > 1:
        weakest = min((s, k) for k, s in enumerate(share) if s > 0)[1]
        less = [0.0 if k == weakest else s for k, s in enumerate(share)]
        less, low = settle([s / sum(less) for s in less])
        if fit - low > penalty * np.log(len(like) + 1):
            break
        share, fit = less, low
    return share


def test_mixture_by_plain_loops():
    rng = np.random.default_rng(8)
    for runs in (1, 3, 20, 60):
        like = np.log(rng.dirichlet(np.full(5, 0.4), runs) + 1e-4)
        assert language_id.mixtures(like, np.array([0]))[0] == pytest.approx(plain_mixture(like.tolist()), abs=1e-9)


def test_mixture_finds_both_languages():
    like = np.log(np.array([[0.9, 0.05, 0.05]] * 30 + [[0.05, 0.9, 0.05]] * 10 + [[0.9, 0.05, 0.05]] * 5))
    share = language_id.mixtures(like, np.array([0, 40]))
    assert share[0] == pytest.approx([0.75, 0.25, 0], abs=0.05) and share[1].tolist() == [1, 0, 0]


def test_url_parts_and_listed_rules(spark):
    urls = [None, "no scheme/x", "http://A.Example.NET/en/1?x://y", "http://b.net/", "http://b.net", "http://example.net/de/", "http://notnet/x", "http://c.org/fr/#a", "http://x.example.com/de/1", "a://b://c/d"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labelled = spark.createDataFrame([], "url string, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df, labelled).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[3][2:] == ("net/", "block") and got[4][1:] == ("", None, "allow")
    assert got[5][2] == "net/" and got[6][2] is None and got[7][2:] == ("org/fr/", "allow") and got[8][2:] == ("example.com/de/", "block") and got[9][:2] == ("b:", "//c/d")
    assert url_rules.judge(df.limit(0), labelled).count() == 0


def brute_rules(rows, support, lift, width):
    """Every combination of the tokens that stand in some row, counted one by one."""
    rows = [(set(has), bad) for has, bad in rows]
    base = sum(bad for _, bad in rows) / len(rows)
    where = {t: frozenset(i for i, (has, _) in enumerate(rows) if t in has) for has, _ in rows for t in has}
    least = max(support * len(rows), url_rules.ROWS)
    items = {t: at for t, at in where.items() if len(at) >= least and t == min(u for u in where if where[u] == at)}
    found = {}
    for has, _ in rows:
        mine = sorted(has & items.keys())
        for size in range(1, len(mine) + 1):
            for few in combinations(mine, size):
                at = frozenset.intersection(*(items[t] for t in few))
                n, bad = len(at), sum(rows[i][1] for i in at)
                if n >= least and bad >= least:
                    share, z = bad / n, width**2
                    low = (share + z / (2 * n) - width * (share * (1 - share) / n + z / (4 * n * n)) ** 0.5) / (1 + z / n)
                    if low >= lift * base:
                        found[few] = (n, bad)
    sure = {few: bad / n for few, (n, bad) in found.items()}
    kept = [few for few in found if not any(set(p) < set(few) and sure[p] >= sure[few] for p in found)]
    return {(tuple(sorted(t for i in few for t in where if where[t] == items[i])), *found[few]) for few in kept}


def test_mined_rules_by_brute_force(spark):
    rng = np.random.default_rng(6)
    urls = ["http://{}.{}/{}?{}=1".format(*(rng.choice(x) for x in (["a", "b-c", "www.d"], ["org", "net"], ["x/y", "x", "z/9", "en/y/q"], ["p", "q"]))) for _ in range(600)]
    rows = [(u, bool(rng.random() < 0.1 + 0.6 * ("net" in u and "/y" in u) + 0.4 * ("b-c" in u and "q=" in u))) for u in urls] + [(None, True), ("http://a.org/", None)]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    has = {r.url: r.has for r in df.select("url", url_rules.tokens(F.col("url")).alias("has")).collect()}
    for support, lift, width in ((0.02, 1.5, 2.0), (0.05, 1.0, 0.0), (0.02, 1.2, 3.0)):
        rules = url_rules.mine(df, support, lift, width)
        want = brute_rules([(has[u], bad) for u, bad in rows if u and bad is not None], support, lift, width)
        assert {(tuple(r.tokens), r.n, r.n_bad) for r in rules.collect()} == want and len(want) > 1
    surest = {u: max((b / n for t, n, b in want if set(t) <= set(has[u])), default=None) for u in has if u}
    judged = url_rules.judge(df.selectExpr("1 page_id", "url", "2 rule", "3 confidence"), df, (), support, lift, width).select("verdict", "confidence").collect()
    assert sorted(r.confidence or 0 for r in judged) == pytest.approx(sorted(surest[u] or 0 if u else 0 for u, _ in rows))
    assert {(r.verdict, r.confidence is None) for r in judged} == {("block", False), ("allow", True)}


def test_labels_that_dont_depend_on_the_url_make_no_rules(spark):
    rng = np.random.default_rng(7)
    rows = [(f"http://{h}.org/{p}", bool(rng.random() < 0.25)) for h in "abcdefgh" for p in "uvwxyz" for _ in range(40)]
    assert url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean")).count() == 0
    for bad in (True, False):
        assert url_rules.mine(spark.createDataFrame([(u, bad) for u, _ in rows], "url string, bad boolean")).count() == 0


def test_rules_of_common_tokens_in_long_urls(spark):
    """What makes a URL bad are two tokens more common than nine others that stand beside them."""
    tail = "/".join(f"r{c}" for c in "abcdefghi")
    kinds = [("p/q/" + tail, True, 30), ("p/" + tail, False, 15), ("q/" + tail, False, 15), ("p", False, 60), ("q", False, 60)]
    df = spark.createDataFrame([(f"http://h.org/{x}", bad) for x, bad, n in kinds for _ in range(n)], "url string, bad boolean")
    assert [(r.tokens, r.confidence) for r in url_rules.mine(df, 0.05, 4.0).collect()] == [(["path:p", "path:q"], 1.0)]
    long = spark.createDataFrame([("http://h.org/" + "p/q/" * 50_000, 1)], "url string, page_id int")
    assert url_rules.judge(long, df, (), 0.05, 4.0).first().verdict == "block"


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[300:420] = x[7]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (1000, [float("nan")] * 8), (1100, [None] * 8), (1200, [1.0, 2.0]), (1300, []), (None, [1.0] * 8)]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    v = {i: np.floor(1024 * np.pad(np.array(e, np.float32).astype(np.float64), (0, 8 - len(e)))).astype(int) for i, e in rows if i is not None and e is not None and None not in e and all(np.isfinite(e))}
    want = {}
    for q in (i for i in v if i % 100 == 0):
        for k, (s, i) in enumerate(sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:10]):
            want[q, k + 1] = (i, -s)
    assert got == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_cover_tree_nests_covers_and_separates():
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(2500, 6)) * 50 + c for c in rng.normal(size=(4, 6)) * 4000] + [np.zeros((300, 6))])
    points, levels, parents, owner = topk.cover_tree(x)
    assert len(points) > 50 and len(set(levels.tolist())) > 3
    gap = lambda a, b: np.sqrt(((a - b) ** 2).sum(axis=-1))
    for k in range(1, len(points)):
        assert levels[parents[k]] > levels[k] and gap(x[points[k]], x[points[parents[k]]]) < 2.0 ** (levels[k] + 1)
        assert gap(x[points[:k]], x[points[k]]).min() >= 2.0 ** levels[k]
    assert all(gap(x[i], x[points[owner[i]]]) == pytest.approx(gap(x[points], x[i]).min()) for i in range(0, len(x), 37))
    root, stack = topk.nodes(x, (points, levels, parents, owner)), []
    stack.append(root)
    while stack:
        node = stack.pop()
        assert gap(x[node.rows], node.centre).max(initial=0) <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children]).tolist()) == sorted(node.rows.tolist())
            assert any((c.centre == node.centre).all() for c in node.children)
        stack += node.children
    assert sorted(root.rows.tolist()) == list(range(len(x)))


def test_top_k_with_repeated_ids_and_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(15)
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "ASKED", 2)
    rows = [(i % 600, [float(v) for v in rng.integers(-3, 4, 4)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 id", "2 part", "3 score")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df).collect()}
    v = [(i, np.floor(1024 * np.array(e)).astype(int)) for i, e in rows]
    for q in range(0, 600, 100):
        one = min((e.tolist() for i, e in v if i == q))
        want = sorted((-int(np.dot(one, e)), i) for i, e in v if i != q)[:10]
        assert [got[q, k + 1] for k in range(10)] == [(i, -s) for s, i in want]


def test_dual_tree_keeps_all_ties():
    x = np.ones((500, 4), np.int64)
    best = topk.dual_search(x[:2], np.array([0, 1]), x, np.arange(500), 3, np.full(2, -1e18))
    assert best == [[(4, 1), (4, 2), (4, 3)], [(4, 0), (4, 2), (4, 3)]]


def brute_measures(t):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, at = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            at |= {i + j for i in places for j in range(8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(at)


def test_rules(spark, docs):
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(100, "a b c d e f g h i " * 2), (101, "x\nx\n \n\ny #"), (102, "z " * 30)], "doc_id long, text string"))
    got = {r.doc_id: r for r in quality.judged(more).collect()}
    for r in more.collect():
        g, want = got[r.doc_id], brute_measures(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (g.base_failed and g.kept)
    out = quality.cascade(more)
    assert {r.doc_id for r in out.filter("rejected_by is null").collect()} == {d for d, r in got.items() if r.kept}
    assert quality.judged(docs.limit(0)).count() == 0 and quality.cascade(docs.limit(0)).count() == 0


def test_chat_reads_back(spark):
    rows = [(1, i, ["system", "user", "assistant"][i % 3 if i else 0], f"<|turn|>␛1␛[INST] {i} " + "word " * (i * 9)) for i in range(30)]
    rows += [(2, 0, None, None), (2, None, "assistant", "x"), (2, 0, "role\n<|end|>", "</s>"), (3, 5, "assistant", "é" * 9000), (None, 1, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 window", "2 size")
    made = chat.windows(df).cache()
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    for c in (1, 2, 3, None):
        turns = sorted(((-1 if t is None else t, r or "", x or "") for k, t, r, x in rows if k == c))
        text = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        learned = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert made.filter("n_tokens > 480 and n_turns - n_repeats > 1").count() == 0
    assert made.filter("conv_id = 1 and not text like '<|turn|>system%'").count() == 0
    assert chat.windows(df.limit(0)).count() == 0


def test_windows_keep_their_budget(spark):
    """System turn, history and own turns share the budget; only a turn that is too long alone exceeds it."""
    rng = np.random.default_rng(4)
    rows = []
    for c, system in enumerate((0, 30, 200, 236, 237, 5000)):
        rows += [(c, 0, "system", "x " * system)] if system else []
        rows += [(c, 1 + i, ("user", "assistant")[i % 2], "y " * int(rng.integers(0, 90 if i % 9 else 700))) for i in range(60)]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).cache()
    assert made.filter("n_tokens > 480 and n_turns - n_repeats > 1").count() == 0
    assert made.filter("n_turns - n_repeats > 1 and n_repeats > 1").count() > 10
    size = lambda n: n + 4
    for r in made.filter("n_tokens > 480").collect():
        assert size(r.text.split("<|turn|>")[-1].count("y ") or 5000) + (size((0, 30, 200, 236, 0, 0)[r.conv_id]) if r.n_repeats else 0) > 480
    # the system turn leads every window where it fits, and none but its own where it doesn't
    for c, leads in enumerate((False, True, True, True, False, False)):
        later = made.filter(f"conv_id = {c} and window > 0")
        assert later.count() > 3 and later.filter("text like '<|turn|>system%'").count() == (later.count() if leads else 0)
    targets = made.selectExpr("conv_id", "explode(transform(loss, s -> substr(text, int(s.start) + 1, int(s.length)))) t").groupBy("conv_id").agg(F.count("*").alias("n")).collect()
    assert {r.n for r in targets} == {30}
    with pytest.raises(ValueError):
        chat.windows(made, 100, 50)


def test_scores_tell_target_from_background(spark, docs):
    rows = [(i, ("alpha beta gamma " if i % 2 else "one two three ") * 20) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    target = df.filter("doc_id % 4 = 1").select("doc_id")
    got = {r.doc_id: r.score for r in lm_score.score(df, target).collect()}
    assert min(v for d, v in got.items() if d % 2) > max(v for d, v in got.items() if d % 2 == 0)
    odd = {r.doc_id: r for r in lm_score.score(docs, docs.limit(0)).collect()}
    assert odd[2].n_tokens == 0 and odd[2].score is None and odd[6].n_tokens == 2 and len(odd) == 15
    assert lm_score.score(docs.limit(0), docs).count() == 0
    assert [(r.n_tokens, r.score) for r in lm_score.score(docs.filter("doc_id in (2, 3, 4)"), docs).collect()] == [(0, None)] * 3


def test_lm_losses_by_brute_force(spark, docs):
    """Every word and pair has its own count, and losses are those of conditional probabilities."""
    df = docs.select("doc_id", "text").union(spark.range(60).selectExpr("id + 100", "concat_ws(' ', transform(sequence(1, 3000), x -> concat('v', (x * x + 7 * id) % (9000 + id))))"))
    rows, chosen = df.collect(), {0, 8, 13, *range(100, 120)}
    texts = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), r.text or "")) for r in rows]
    grams = [(Counter(w), Counter([None, *w][: len(w)]), Counter(zip([None, *w], w, strict=False))) for w in texts]
    models = [(Counter(), Counter(), Counter()) for _ in range(2)]
    for r, own in zip(rows, grams, strict=True):
        for m in models[0 if r.doc_id in chosen else 1 :]:
            for c, x in zip(m, own, strict=True):
                c.update(x)
    size = len(models[1][0])
    assert len(models[1][2]) > 100_000

    def loss(m, own, w, less):
        """The row's own counts are taken out where the model has them."""
        total, each = sum(m[0].values()) - less * len(w), []
        for past, x in zip([None, *w], w, strict=False):
            word, met, seen = (c[k] - less * o[k] for c, o, k in zip((m[0], m[2], m[1]), (own[0], own[2], own[1]), (x, (past, x), past), strict=True))
            alone = (word + 0.5) / (total + 0.5 * size)
            each.append(-np.log(0.7 * met / seen + 0.3 * alone if seen else alone))
        return np.mean(each)

    got = {r.doc_id: r for r in lm_score.score(df, spark.createDataFrame([(d,) for d in chosen], "doc_id long")).collect()}
    assert len(got) == len(rows)
    for r, own, w in zip(rows, grams, texts, strict=True):
        g = got[r.doc_id]
        assert g.n_tokens == len(w)
        if w:
            a, z = loss(models[0], own, w, r.doc_id in chosen), loss(models[1], own, w, 1)
            assert (g.target_loss, g.background_loss, g.score) == pytest.approx((a, z, z - a), abs=1e-9), r.doc_id


def test_scores_of_repeated_rows(spark):
    """A row that stands there twice is known from the other one."""
    rows = [(i, " ".join(f"w{(i * 31 + j * j) % 977}" for j in range(80))) for i in range(30)]
    once = {r.doc_id: r.background_loss for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1,)], "doc_id long")).collect()}
    df = spark.createDataFrame([*rows, rows[7]], "doc_id long, text string").selectExpr("*", "1 score", "2 n_tokens", "3 chunk")
    twice = [r.background_loss for r in lm_score.score(df, spark.createDataFrame([(1,)], "doc_id long")).filter("doc_id = 7").collect()]
    assert len(twice) == 2 and twice[0] == twice[1] < once[7] - 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (150, 200), (7, 7), (None, 1)] + [(500, 501 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 150: 100, 200: 100} | {i: 500 for i in range(500, 551)}


def test_pipeline_keeps_clean_documents(spark):
    docs, columns = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), None
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = Scratch(spark, "t").cut(stage(spark, docs, "/root/testdata/sf0.001"))
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] / 2
    assert docs.filter("n_chars <> length(text)").count() == 0
    ids = {r.doc_id for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id").collect()}
    assert ids == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_of_odd_documents(spark, docs):
    rows = docs.selectExpr("doc_id", "text", "lang", "'s' source", "cast(length(text) as bigint) n_chars")
    for _, stage in corpus_pipeline.STAGES:
        rows = Scratch(spark, "t").cut(stage(spark, rows, ""))
    assert rows.filter("sequence_id is null").count() == 0
