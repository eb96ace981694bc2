"""The corpus operators against brute force, exact round trips and held-out accuracy, and on odd input."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import chat_format, decontam, graph, language_id, license_scan, line_dedup, lm_scoring, mixing, ngram_join, quality_rules, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, __w string, cid string, n string"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared passages, odd ids and odd texts, and columns with clashing names."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdefgé", k=rnd.randint(2, 7))) for _ in range(400)]
    sentence = lambda k: " ".join(rnd.choices(vocabulary, k=k)).capitalize() + "."
    passage = sentence(60)
    texts = []
    for i in range(n):
        t = "\n".join(sentence(rnd.randint(3, 25)) for _ in range(rnd.randint(1, 6)))
        if i % 7 == 3:
            t = texts[rnd.randrange(len(texts))] or t
        elif i % 7 == 4:
            words = (texts[rnd.randrange(len(texts))] or t).split(" ")
            words[rnd.randrange(len(words))] = "changed"
            t = " ".join(words)
        elif i % 7 == 5:
            t += "\n" + passage
        texts.append(t)
    texts += [None, "", " \n\t", "a", "a b", "A B", "a " * 300, "zzzz" * 2000, "é" * 60, "x" * 49, "x" * 50, "x" * 51, sentence(3000)]
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}" if i % 5 else None, len(t or ""), "q", "q", "q", "q") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, null columns, repeated rows."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, text), (1, text), (None, text), (None, None), (2, None), (3, ""), (3, text + " fifteen")]
    return spark.createDataFrame([(a, b, None, None, None, None, None, None, None) for a, b in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# --- 1 --------------------------------------------------------------------------------------------


def brute_substrings(items):
    first: dict[bytes, int] = {}
    raw = [(i, (t or "").encode()) for i, t in items]
    for i, b in raw:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    out = {}
    for i, b in raw:
        mask = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                mask[k : k + 50] = True
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out[i] = (len(b), int(mask.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, dtype=np.uint8)[~mask])).hexdigest())
    return out


def test_suffix_order():
    rng = np.random.default_rng(3)
    for n, kinds, length in [(1, 1, 50), (7, 1, 50), (50, 1, 50), (200, 2, 50), (333, 3, 10), (1000, 4, 10**9), (998, 1, 10**9)]:
        s = rng.integers(1, kinds + 1, n)
        order = suffix_dedup.suffix_order(s, 1, length).tolist()
        assert sorted(order) == list(range(n))
        cut = [tuple(s[i : i + length]) for i in order]
        assert cut == sorted(cut)


def test_string_hashes_and_keys():
    buf = np.random.default_rng(1).integers(0, 3, 500).astype(np.uint8)
    h, k = suffix_dedup.string_hashes(buf, 50), suffix_dedup.string_keys(np.concatenate([buf, buf]))
    assert len(h) == 451 and (k[:451] == k[500:951]).all()


def test_suffix_dedup(docs):
    expected = brute_substrings(pairs(docs))
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup_substrings(docs).collect()}
    assert found == expected and sum(v[1] for v in expected.values()) > 1000


def test_suffix_dedup_hot_keys(docs, monkeypatch):
    """Keys of many documents go string by string, with the same result."""
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    expected = brute_substrings(pairs(docs))
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup_substrings(docs, with_text=False).collect()}
    assert found == expected


def test_suffix_dedup_odd(odd, empty):
    out = suffix_dedup.dedup_substrings(odd).collect()
    removed = sorted((r["doc_id"] if r["doc_id"] is not None else 99, r["n_bytes"], r["n_removed"]) for r in out)
    n = len("one two three four five six seven eight nine ten eleven twelve thirteen fourteen")
    assert removed == sorted([(1, n, 0), (1, n, 0), (99, n, n), (99, 0, 0), (2, 0, 0), (3, 0, 0), (3, n + 8, n)])
    assert suffix_dedup.dedup_substrings(empty).count() == 0


# --- 2 --------------------------------------------------------------------------------------------


def test_line_dedup(spark, empty, odd):
    rows = [(i, f"Unique text number {chr(97 + i)} {chr(98 + i)} of its own kind\nDownloaded {i} times on day {i * 7} by user{i} from the site\nShort line") for i in range(8)]
    rows += [(100 + i, "A copied document with a line\nand another line of the copied document") for i in range(9)]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(df, report=True).collect()}
    assert all(out[i]["n_dropped"] == 1 and out[i]["text"].split("\n")[1] == "Short line" for i in range(8))
    assert all(out[100 + i]["n_dropped"] == 0 for i in range(9))
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.dedup_lines(odd).count() == odd.count()
    lines = {r["doc_id"]: r["n_lines"] for r in line_dedup.line_report(odd).collect()}
    assert lines[2] == 1


def texts_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def own_lines(rnd, k):
    return [" ".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(k)]


def test_line_dedup_beside_copies(spark):
    rnd = random.Random(5)
    line = "Subscribe to our letter for more of this"
    copy = "\n".join([*own_lines(rnd, 6), line])
    unlike = ["\n".join([*own_lines(rnd, 4), line]) for _ in range(40)]
    out = line_dedup.dedup_lines(texts_of(spark, unlike + [copy] * 300), report=True).collect()  # 41 contexts in 340 documents
    assert all(r["n_dropped"] == 1 and line not in r["text"] for r in out)


def test_line_dedup_passages_and_near_copies(spark):
    rnd = random.Random(6)
    passage, base = own_lines(rnd, 6), own_lines(rnd, 20)
    unlike = ["\n".join(own_lines(rnd, 6) + passage) for _ in range(60)]
    near = []
    for k in range(200):
        lines = [*base, passage[0]]
        lines[k % 20] = own_lines(rnd, 1)[0]
        near.append("\n".join(lines))
    out = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(texts_of(spark, unlike + near), report=True).collect()}
    assert [out[i] for i in range(60)] == [6] * 60 and [out[60 + k] for k in range(200)] == [1] * 200


@pytest.mark.parametrize("own", [12, 8, 4, 2])
def test_line_dedup_of_pages_that_are_mostly_common_lines(spark, own):
    """However little a page has of its own beside them, the common lines go; a group of near copies alone stays."""
    rnd = random.Random(own)
    common, base = own_lines(rnd, 14), own_lines(rnd, 18)
    pages = ["\n".join(common[:7] + own_lines(rnd, own) + common[7:]) for _ in range(300)]
    near = ["\n".join(x if i != k % 18 else x[:-1] + str(k) for i, x in enumerate(base)) for k in range(300)]
    out = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(texts_of(spark, pages + near), report=True).collect()}
    assert [out[k] for k in range(300)] == [14] * 300 and [out[300 + k] for k in range(300)] == [0] * 300


def test_line_dedup_of_pages_put_together_from_common_lines(spark):
    rnd = random.Random(8)
    lines = own_lines(rnd, 60)
    out = line_dedup.dedup_lines(texts_of(spark, ["\n".join(rnd.sample(lines, 10)) for _ in range(200)]), report=True).collect()
    assert sum(r["n_dropped"] for r in out) == 2000


def test_line_dedup_short_lines(spark):
    rnd = random.Random(7)
    texts = ["\n".join([*own_lines(rnd, 3), "All rights reserved.", "", f"Page {k}"]) for k in range(30)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(texts_of(spark, texts), min_tokens=1).collect()}
    assert all(out[k] == t.replace("\nAll rights reserved.", "") for k, t in enumerate(texts))


# --- 3 --------------------------------------------------------------------------------------------


def test_decontamination(spark, docs, odd, empty):
    base = [t for _, t in pairs(docs) if t and len(t.split()) > 40]
    items = [(1, base[0][20:200]), (2, " ".join(base[1].upper().split()[5:16])), (3, "A b"), (4, None), (5, "..."), (2, "other words that nobody uses at all here in any text"), (10, base[2])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    sep = __import__("re").compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: sep.findall((t or "").translate({k: k + 32 for k in range(65, 91)}))
    windows = defaultdict(set)
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - 9)) if w else []:
            windows[tuple(w[k : k + 10])].add(str(i))
    for source in (docs, odd):
        found = sorted(tuple(r) for r in decontam.contamination_report(source, benchmark).select(F.coalesce("doc_id", F.lit(-1)), "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
        expected = []
        for i, t in pairs(source):
            w, hit, names = low(t), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in windows:
                        hit |= set(range(k, k + n))
                        names |= windows[tuple(w[k : k + n])]
            expected.append((-1 if i is None else i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
        assert found == sorted(expected)
    clean = decontam.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(not r[5] for r in decontam.contamination_report(docs, benchmark).collect())
    cut = decontam.decontaminate(docs, benchmark, "spans")
    lost = {r["doc_id"]: r["n_words"] for r in decontam.contamination_report(cut, benchmark).collect()}
    assert all(lost[r["doc_id"]] == r["n_words"] - r["n_hit"] for r in decontam.contamination_report(docs, benchmark).collect())
    assert decontam.contamination_report(empty, benchmark).count() == 0
    none = decontam.contamination_report(docs, benchmark.limit(0))
    assert none.count() == docs.count() and none.where("contaminated").count() == 0


def test_cut_spans(spark):
    d = spark.createDataFrame([(1, "Keep this, A b c d e f g h i j! and that.")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a B c d e f g h i j")], "item_id long, text string")
    assert decontam.decontaminate(d, b, "spans").first()["text"] == "Keep this, and that."


# --- 4 --------------------------------------------------------------------------------------------


def brute_scores(items, order):
    train = [["<s>"] * (order - 1) + [w.decode() for w in (t or "").encode().lower().split()] + ["</s>"] for i, t in items if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    counts, raw = {order: Counter()}, Counter()
    for w in train:
        for i in range(order - 1, len(w)):
            counts[order][tuple(w[i - order + 1 : i + 1])] += 1
            raw[w[i]] += 1
    for m in range(order - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    ds = {m: lm_scoring.discounts([sum(c == k for c in counts[m].values()) for k in (1, 2, 3, 4)]) for m in counts}
    stats = {m: defaultdict(lambda: [0, 0, 0, 0]) for m in counts}
    for m in counts:
        for g, c in counts[m].items():
            stats[m][g[:-1]][0] += c
            stats[m][g[:-1]][min(c, 3)] += 1
    v, n = len(raw), sum(raw.values())

    def p(g):
        if not g:
            return 1 / (v + 1)
        m, s = len(g), stats[len(g)].get(g[:-1])
        if not s:
            return p(g[1:])
        c = counts[m].get(g, 0)
        return max(c - [0, *ds[m]][min(c, 3)], 0) / s[0] + sum(ds[m][k] * s[k + 1] for k in range(3)) / s[0] * p(g[1:])

    out = []
    for i, t in items:
        w = ["<s>"] * (order - 1) + [x.decode() for x in (t or "").encode().lower().split()] + ["</s>"]
        grams = [tuple(w[k - order + 1 : k + 1]) for k in range(order - 1, len(w))]
        out.append((-1 if i is None else i, len(grams), sum(raw[g[-1]] > 0 for g in grams), n, sum(math.log10((raw[g[-1]] + 0.5) / (n + 0.5 * (v + 1))) for g in grams), sum(math.log10(p(g)) for g in grams)))
    return sorted(out), p, raw


@pytest.mark.parametrize("order", [2, 3, 4, 5])
def test_lm_scores(docs, odd, order):
    for source in (docs, odd):
        expected, p, raw = brute_scores(pairs(source), order)
        rows = lm_scoring.score_report(source, order).select(F.coalesce("doc_id", F.lit(-1)), "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
        for a, b in zip(sorted(tuple(r) for r in rows), expected, strict=True):
            assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 and abs(a[5] - b[5]) < 1e-6
        total = sum(p((("<s>",) * (order - 1)) + (w,)) for w in raw) + p((("<s>",) * (order - 1)) + ("never seen",))
        assert abs(total - 1) < 1e-9


def test_lm_empty(empty):
    assert lm_scoring.score_report(empty).count() == 0


# --- 5 --------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    hard = "\\### Assistant: </turn> ok"
    turns = [(1, 0, "user", hard), (1, 1, "assistant", hard), (2, 1, "assistant", "\\b\\l\\\\h#<:"), (2, 0, "system", ""), (3, None, None, None), (3, 0, "user", "a</turn>\n### user: b"), (3, 0, "user", "a"), (None, 0, "user", "x\n"), (4, 0, "user", "é" * 5), (4, 1, "assistant", "ok"), (4, 2, "assistant", "again")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    digests = {r["conv_id"]: r for r in chat_format.conversation_digests(df).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted(((t if t is not None else -1), r or "", x or "") for c, t, r, x in turns if c == conv)
        r = digests[conv]
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        loss = "".join(b for _, a, b in own if a == "assistant")
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert digests[1]["valid"] and not digests[4]["valid"] and digests[4]["n_violations"] == 1 and not digests[2]["valid"]
    seg = chat_format.format_conversations(df).where("conv_id = 1").first()
    assert "".join(s["text"] for s in seg["segments"]) == seg["formatted"] and sum(s["loss"] for s in seg["segments"]) == 1
    assert chat_format.conversation_digests(df.limit(0)).count() == 0


# --- 6 --------------------------------------------------------------------------------------------


def test_licenses(spark, odd, empty):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    rows = [(1, "x Released under the MIT License. mit license"), (2, "Licensed under the Apache License, Version 2.0."), (3, mit), (4, "nothing here"), (5, None), (6, "CC-BY and cc by"), (7, "gnu general public\nLICENSE, version 2"), (8, mit.replace("without restriction", "with fun"))]
    out = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1]["n_base"], out[1]["first_word"], out[1]["last_word"], out[1]["base_labels"]) == (2, 4, 6, "mit") and "mit-notice" in out[1]["labels"]
    assert out[2]["labels"] == "apache,apache-2.0" and out[3]["labels"] == "mit-text" and out[3]["score"] == 1.0
    assert out[4]["labels"] == "" and out[4]["first_word"] is None and out[5]["n_words"] == 0
    assert out[6]["n_base"] == 2 and out[7]["base_labels"] == "gpl" and "mit-text" not in out[8]["labels"]
    assert license_scan.scan_licenses(odd).count() == odd.count() and license_scan.scan_licenses(empty).count() == 0


# --- 7 --------------------------------------------------------------------------------------------


def test_allocate():
    supply = {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 1000}
    got = mixing.allocate(supply, {("a",): 1.0, ("b",): 1.0}, 160)
    assert got == {("a", "x"): 10, ("a", "y"): 70, ("b", "x"): 80}
    short = mixing.allocate(supply, {}, 400)  # a can't supply its half: b gets the rest
    assert short == {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 290}
    assert mixing.allocate(supply, {}, 10**6) == supply and mixing.allocate({}, {}, 5) == {}
    assert mixing.allocate(supply, {("a",): 0.0}, 50) == {("a", "x"): 0, ("a", "y"): 0, ("b", "x"): 50}


def test_mixing(docs, odd, empty):
    mix = mixing.Mix(domains=(("p", ("src0", "src1")),), weights={("p",): 3.0}, fraction=0.6, max_epochs=2)
    out = mixing.mix_sources(docs, mix).collect()
    assert out == [] or set(docs.columns) < set(out[0].asDict())
    tokens = {i: len((t or "").encode().split()) for i, t in pairs(docs)}
    source = {r["doc_id"]: ("p" if r["source"] in ("src0", "src1") else "other", r["lang"] or "", r["source"] or "") for r in docs.collect()}
    supply = Counter()
    for i, n in tokens.items():
        if n:
            supply[source[i]] += n
    quota = mixing.allocate({k: 2 * n for k, n in supply.items()}, mix.weights, int(0.6 * sum(tokens.values())))
    spent, most = Counter(), Counter()
    for r in out:
        leaf = source[r["doc_id"]]
        spent[leaf] += tokens[r["doc_id"]]
        most[leaf] = max(most[leaf], tokens[r["doc_id"]])
        assert r["mix_tokens"] == tokens[r["doc_id"]] > 0
    for leaf, n in quota.items():  # the prefix that begins before the budget is used up
        assert n <= spent[leaf] < n + max(most[leaf], 1) or n == 0 == spent[leaf]
    assert sorted((r["doc_id"], r["mix_epoch"]) for r in out) == sorted((r["doc_id"], r["mix_epoch"]) for r in mixing.mix_sources(docs.repartition(7), mix).collect())
    assert len({(r["doc_id"], r["mix_epoch"]) for r in out}) == len(out)
    assert mixing.mix_sources(empty, mix).count() == 0 and mixing.mix_sources(odd, mix).count() > 0


# --- 8 --------------------------------------------------------------------------------------------


def test_quality(docs, odd, empty):
    for i, t in pairs(docs):
        words = (t or "").encode().split()
        w = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        c = Counter(w)
        hit = {k + j for k, x in enumerate(w) if c[x] > 1 for j in range(8)}
        assert quality_rules.repeated_words(words) == len(hit)
    clean = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)) + "."
    assert quality_rules.measure(clean)[6]
    assert not quality_rules.measure(clean + "\n" + " | ".join(f"nav{chr(97 + k)}{chr(98 + k)}entry" for k in range(20)) * 9)[6]
    assert quality_rules.line_fails("All rights reserved.", 3) == "boilerplate" and quality_rules.line_fails("Home", 1) == "navigation"
    assert quality_rules.line_fails("a$$$ b### c***", 3) == "symbols" and quality_rules.line_fails("Homes are built of stone.", 5) is None
    out = quality_rules.clean_lines(odd)
    assert out.count() == odd.count() and out.where("doc_id = 2").first()["n_words"] == 0 and quality_rules.quality_report(empty).count() == 0


# --- 9 --------------------------------------------------------------------------------------------


def test_language_id(spark, odd, empty):
    words = {"en": "the and of with which this there would about people", "de": "der und nicht eine durch werden schön über auch zwischen", "es": "el que para con señor muchas porque también donde años"}
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        lang = sorted(words)[i % 3]
        rows.append((i, " ".join(rnd.choices(words[lang].split(), k=30)), None if i % 50 == 7 else lang))
    rows += [(900, None, "en"), (901, "123 --- 456", "en"), (902, "", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in language_id.language_report(df).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i]["held_out"] for i in held) and sum(out[i]["lang_pred"] == sorted(words)[i % 3] for i in held) >= 0.99 * len(held)
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (900, 901, 902)) and all(0 <= r["score"] <= 1 for r in out.values())
    assert {r["lang_pred"] for r in language_id.language_report(odd).collect()} == {"und"} and language_id.language_report(empty).count() == 0


def test_many_languages():
    grams = {f"l{i:03}": np.arange(i * 100, i * 100 + 100, dtype=np.uint32) for i in range(70)}
    model = language_id.BloomModel(grams, 16)
    assert model.masks.shape == (1 << 16, 2) and all(0 <= f < 0.5 for f in model.false)


# --- 10 -------------------------------------------------------------------------------------------


def brute_groups(items):
    sets = {}
    for i, t in items:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(n: int = 90):
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = f"edit{rnd.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    return rows


@pytest.mark.parametrize("which", ["docs", "copies"])
def test_ngram_join(spark, docs, which):
    df = docs if which == "docs" else spark.createDataFrame(near_copies(), "doc_id long, text string")
    expected = brute_groups(pairs(df))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(df).collect()}
    assert found == expected and len({v[1] for v in expected.values()}) < len(expected)


@pytest.mark.parametrize("which", ["docs", "copies"])
def test_ngram_join_splits_hot_tokens(spark, docs, which, monkeypatch):
    """Every token of two sets as a hot one, cells of two sets: the same groups."""
    df = docs if which == "docs" else spark.createDataFrame(near_copies() * 2, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(ngram_join, "HOT", 0)
    monkeypatch.setattr(ngram_join, "CELL", 2)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(df, part_tokens=2000).collect()}
    assert found == brute_groups(pairs(df))


def test_ngram_join_odd(odd, empty):
    out = sorted((r["doc_id"] or 99, r["n_shingles"], r["component_id"] or 99) for r in ngram_join.similar_groups(odd).collect())
    assert out == [(1, 12, 1), (1, 12, 1), (2, 0, 2), (3, 0, 3), (3, 13, 1), (99, 0, 99), (99, 12, 1)]
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 2, 3]
    assert ngram_join.similar_groups(empty).count() == 0


def test_parity_sketch():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 1 << 20, 200).astype(np.uint64) << np.uint64(8)) for _ in range(2))
        x, y = (np.array(ngram_join.parity_sketch(s)).view(np.uint64) for s in (a, b))
        assert sum(bin(int(p ^ q)).count("1") for p, q in zip(x, y, strict=True)) <= len(np.setxor1d(a, b))


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(500, k) for k in range(501, 560)] + [(600 + k, 601 + k) for k in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    found = dict(tuple(r) for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    loops = {a for a, b in edges if a == b}
    assert all(found[i] == find(i) for i in found) and set(parent) - set(found) <= loops
