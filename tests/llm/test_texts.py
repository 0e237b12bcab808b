"""Problems 7, 8 and 9: leaks against brute force, exact round trips and shares."""

import random
import string

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewheel.llm import leaks, mixing, pieces
from tidewheel.llm.tokens import VOCABULARY, encoding

DOCS = "doc_id long, text string"
ITEMS = "item_id long, lang string, text string"
WORDS = ["".join(random.Random(i).choices(string.ascii_lowercase, k=2 + i % 6)) for i in range(160)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# 7


def brute_leaks(docs, items):
    """Every passage of every item beside every place of every document."""
    stock = leaks.stock_sentences(items)
    out = set()
    for chinese, cutter, least in ((False, leaks.words, 15), (True, leaks.chars, 30)):
        read = leaks.read_items(items, chinese, stock)
        for item, units, counted in zip(read.ids, read.units, read.counted, strict=True):
            for doc, text in docs:
                if not text:
                    continue
                d = [read.vocabulary.get(u, 0) for u in cutter(leaks.plain_text(text))]
                for shift in range(-len(units), len(d)):
                    same = [0 <= shift + c < len(d) and d[shift + c] == units[c] for c in counted]
                    for a in range(len(same) - least + 1):
                        if same[a]:
                            wrong = 0
                            for b in range(a, len(same)):
                                wrong += not same[b]
                                if b - a + 1 - wrong >= least and same[b] and wrong * 8 <= b - a + 1:
                                    out.add((doc, item))
    return out


def leak_case(seed):
    rng = random.Random(seed)
    stock = ["All of this is said in every item and counts for nothing at all here today my friend."]
    items = [(i, "en", ". ".join(sentence(rng, rng.randint(4, 14)) for _ in range(rng.randint(1, 4))) + ". " + (stock[0] if i % 3 == 0 else "")) for i in range(25)]
    zh = [chr(0x4E00 + i) for i in range(60)]
    items += [(100 + i, "zh", "。".join("".join(rng.choice(zh) for _ in range(rng.randint(10, 25))) for _ in range(3)) + "。") for i in range(8)]
    docs = []
    for k in range(60):
        parts = [sentence(rng, rng.randint(0, 30)) for _ in range(3)]
        item = rng.choice(items)
        if item[1] == "zh":
            u = list(item[2])
            a = rng.randint(0, len(u) // 2)
            u = u[a : a + rng.randint(20, 60)]
            u = [rng.choice(zh) if rng.random() < 0.06 else x for x in u]
            parts.insert(1, "\n".join("".join(u)[i : i + 9] for i in range(0, len(u), 9)))
        else:
            u = item[2].split()
            a = rng.randint(0, max(0, len(u) - 16))
            u = u[a : a + rng.randint(8, 40)]
            u = [rng.choice(WORDS) if rng.random() < 0.08 else x for x in u]
            parts.insert(1, " ".join(u).upper() if k % 2 else "\n> ".join(u))
        if rng.random() < 0.3:
            parts.append(stock[0])
        docs.append((k, " ".join(parts)))
    return docs + [(900, None), (901, ""), (902, docs[0][1]), (903, docs[0][1] + " " + sentence(rng, 5000))], items


@pytest.mark.parametrize("seed", range(3))
def test_leaks(spark, seed):
    docs, items = leak_case(seed)
    want = brute_leaks(docs, items)
    assert len(want) > 15
    for shard in (500, 2_000_000):
        df = spark.createDataFrame([*docs, (None, docs[0][1])], DOCS).repartition(2).select("*", F.lit(1).alias("item_id"), F.lit(2).alias("TEXT"))
        out = leaks.leaks(df, spark.createDataFrame([*items, (None, "en", "x"), (7777, None, None), items[0]], ITEMS), shard, 10)
        assert {(r["doc_id"], r["item_id"]) for r in out.collect()} == want
        assert out.count() == len(want)
    clean = leaks.without_leaks(df, out)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want} | {None}


@pytest.mark.parametrize(
    "dress",
    [
        str.upper, lambda t: t.replace(" ", " "), lambda t: t.replace("a", "а").replace("e", "е"), lambda t: "​".join(t), lambda t: t.replace(" ", "\n| "), lambda t: f"<p><b>{t.replace(' ', '</b> <i>')}</i></p>",
        lambda t: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t), lambda t: t.replace(". ", ".\n2. "), lambda t: "text='" + t.replace(". ", ".\\n") + "'", lambda t: t.replace("second", "sec-\nond"),
        lambda t: t.replace(" ", " **", 1).replace(" ", "** ", 3), lambda t: t.replace("o", "­o"), lambda t: f"&quot;{t}&quot;".replace(" ", "&nbsp;"), lambda t: t.replace(" ", "\r\n"),
    ],
)
def test_dress(spark, dress):
    text = "Before the 30 second mark, tap the glossy sleeve without pausing next to the shade. Then press the brush at walking pace."
    docs = spark.createDataFrame([(1, "Something before. " + dress(text) + " something after")], DOCS)
    assert [tuple(r)[:2] for r in leaks.leaks(docs, spark.createDataFrame([(5, "en", text)], ITEMS)).collect()] == [(1, 5)]


def test_leak_edges(spark):
    text = " ".join(WORDS[:40])
    items = spark.createDataFrame([(5, "en", text)], ITEMS)
    got = lambda t: leaks.leaks(spark.createDataFrame([(1, t)], DOCS), items).count()
    assert got(" ".join(WORDS[3:18])) == 1 and got(" ".join(WORDS[3:17])) == 0
    assert got(" ".join(WORDS[3:10] + ["zzz"] + WORDS[11:18])) == 0 and got(" ".join(WORDS[3:10] + ["zzz"] + WORDS[11:19])) == 1 and got(" ".join(WORDS[3:8] + ["zzz"] + WORDS[9:12] + ["yyy"] + WORDS[13:18])) == 0
    assert leaks.leaks(spark.createDataFrame([], DOCS), items).count() == 0
    assert leaks.leaks(spark.createDataFrame([(1, text)], DOCS), items.limit(0)).count() == 0


def known_suffix(a, k, longest):
    """The units from k on, up to an unknown one or `longest`."""
    out = a[k : k + longest]
    return out[: out.index(0)] if 0 in out else out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=90), st.lists(st.integers(1, 4), min_size=5, max_size=40), st.sampled_from([5, 9, 16, 40]), st.booleans())
def test_suffix_array(text, test, longest, repeated):
    """All suffixes in true order, searches that find each place, and the longest match of every test suffix."""
    text = text * 2 if repeated else text
    a, t = np.array([*text, *[0] * 8], np.int64), np.array([*test, *[0] * 8], np.int64)
    sa = leaks.suffix_array(a[:-8], longest)
    assert sorted(sa) == [k for k in range(len(text) - 4) if all(text[k : k + 5])]
    kept = [known_suffix(text, k, longest) for k in sa]
    assert kept == sorted(kept)
    tests = np.arange(len(test) - 4)
    low, high = leaks.search(a, sa, t, tests, 5)
    best = leaks.longest_matches(a, sa, t, tests, longest) if len(sa) else np.zeros(len(tests), int)
    for k, i, j, n in zip(tests, low, high, best, strict=True):
        places = [p for p in range(len(text)) if text[p : p + 5] == test[k : k + 5]]
        assert sorted(sa[i:j]) == places
        if places or n >= 5:
            assert n == min(longest, max(next((m for m in range(len(test) - k) if text[p + m : p + m + 1] != [test[k + m]]), len(test) - k) for p in places))


@pytest.mark.parametrize(
    "between",
    [
        "<span class='" + "x" * 5_000 + "'>", "<!-- " + "a word of a comment " * 300 + " -->", "<a\nhref='" + "y/" * 2_000 + "'\n>", "</b><!---->",
        *(f"\n{n}. " for n in (1, 100, 1000, 1001, 123_456)), "\n(xxviii) ", "\n第一",
    ],
)
def test_markup_of_any_length(spark, between):
    """Markup and numbering inside a passage don't hide it, however long they are."""
    text = " ".join(WORDS[:23])
    zh = between == "\n第一"
    broken = " ".join(WORDS[:8]) + (" " if between.startswith("<") else "") + between.replace("第一", "") + " ".join(WORDS[8:16]) + " " + (between if between.startswith("<") else "") + " ".join(WORDS[16:23])
    link = " ".join(WORDS[:8]) + f" [{WORDS[8]}](http://" + "z" * 3_000 + ' "a title") ' + " ".join(WORDS[9:23])
    items = spark.createDataFrame([(5, "en", text)], ITEMS)
    for t in (broken, link) if not zh else (link,):
        assert leaks.leaks(spark.createDataFrame([(1, t)], DOCS), items).collect()[0][:3] == (1, 5, 23)


def test_plain_text_is_linear():
    """Texts of unclosed markup take time in proportion to their length."""
    for part in ("<!-- ", "<a ", "[", "[x](", "1.", "- ", "&", "\\u00", "<", "](", "1.1)", "ivx"):
        import time

        took = []
        for n in (50_000, 200_000):
            began = time.perf_counter()
            leaks.plain_text(part * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 12 * took[0] + 0.5, part


def test_common_seed(spark):
    """One seed at very many places is followed up in blocks, and every document that holds the passage is found."""
    passage = WORDS[:20]
    items = spark.createDataFrame([(5, "en", " ".join(passage)), (6, "en", " ".join(passage[:5] + WORDS[50:70]))], ITEMS)
    docs = [(i, " ".join(passage[:5]) + " zz " + " ".join(passage if i % 10 == 0 else passage[3:9])) for i in range(400)]
    old, leaks.PLACES = leaks.PLACES, 37
    try:
        text = leaks.read_items([(5, "en", " ".join(passage))], False, set())
        get = text.vocabulary.get
        parts = [np.array([get(w, 0) for w in t.split()] + [0]) for _, t in docs]
        begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        assert {m[1] for m in leaks.matches(text, np.concatenate(parts), begin, 15)} == set(range(0, 400, 10))
    finally:
        leaks.PLACES = old
    got = leaks.leaks(spark.createDataFrame(docs, DOCS), items, 2_000, 1).collect()
    assert {(r["doc_id"], r["item_id"], r["verbatim"]) for r in got} == {(i, 5, 20) for i in range(0, 400, 10)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.booleans(), max_size=60))
def test_longest_passage(same):
    n = len(same)
    want = max((b - a for a in range(n) for b in range(a + 15, n + 1) if same[a] and same[b - 1] and 8 * same[a:b].count(False) <= b - a and same[a:b].count(True) >= 15), default=0)
    assert leaks.longest_passage(np.array([same], bool), 15)[0][0] == want


# 8


def mix_tables(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, rng.randint(1, 60)), "hot" if i % 3 == 0 else rng.choice(["a", "b", None])) for i in range(900)]
    rows += [(1000 + i, "one word more", "tiny") for i in range(5)] + [(2000, None, "a"), (2001, "", "b"), (2002, sentence(rng, 20_000), "unlisted")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).select("*", F.lit(1).alias("tokens"), F.lit(1).alias("range"), F.lit("x").alias("SOURCE"))
    targets = spark.createDataFrame([("hot", 0.05, 1), ("a", 0.2, 4), ("b", 0.3, 2), ("tiny", 0.2, 3), ("absent", 0.05, 9), (None, 0.1, 1), ("b", 0.3, 2)], "source string, target_share double, max_repeats int")
    return docs, targets


def test_mix(spark):
    docs, targets = mix_tables(spark)
    counts = mixing.token_counts(docs)
    sizes = {r["doc_id"]: r["tokens"] for r in counts.collect()}
    assert sizes[2000] == sizes[2001] == 0 and len(sizes) == docs.count()
    e = encoding(VOCABULARY)
    assert all(sizes[r["doc_id"]] == len(e.encode_ordinary(r["text"] or "")) for r in docs.select("doc_id", "text").collect())
    wanted = {r["source"]: r for r in mixing.demand(counts, targets).collect()}
    total = sum(sizes.values())
    assert set(wanted) == {"hot", "a", "b", "tiny", "absent"} and wanted["a"]["wanted"] == pytest.approx(0.2 * total)
    short = {r["source"] for r in mixing.short_sources(counts, targets).collect()}
    assert short == {s for s, r in wanted.items() if r["capacity"] < r["wanted"]} and {"tiny", "absent"} <= short
    mixed = mixing.mix(counts, targets)
    rows = mixed.collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    by, uses = {}, {}
    for r in rows:
        by[r["source"]] = by.get(r["source"], 0) + r["tokens"]
        uses[r["doc_id"]] = uses.get(r["doc_id"], 0) + 1
    largest = max(sizes[d] for d in uses)
    for s in ("hot", "a", "b", "tiny"):
        assert abs(by.get(s, 0) - wanted[s]["used"]) <= largest, s
    assert by["tiny"] == wanted["tiny"]["capacity"] and max(uses.values()) <= 4 and len({(r["doc_id"], r["repeat"]) for r in rows}) == len(rows)
    report = {r["source"]: r for r in mixing.reached_shares(counts, targets, mixed).collect()}
    assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1) and report["tiny"]["short"] and not report["hot"]["short"] and report["absent"]["mixed_tokens"] == 0
    assert all(r["missing_tokens"] == pytest.approx(max(0, r["target_share"] * total - r["mixed_tokens"])) and r["share_of_all"] == pytest.approx(r["mixed_tokens"] / total) for r in report.values())
    assert rows == mixing.mix(counts, targets).collect()


def test_curriculum(spark):
    """At any stretch of training each source has about the share that its schedule integrates to there; the weights add up to the same throughout."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, sentence(rng, 5 if i % 2 else 40), "short" if i % 2 else "long") for i in range(3000)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("short", 0.1, 2), ("long", 0.9, 2)], "source string, target_share double, max_repeats int")
    counts = mixing.token_counts(docs)
    plan = {r["source"]: (r["used"], r["a"]) for r in mixing.curriculum(mixing.demand(counts, targets), 1.0).collect()}
    assert sum(u * a for u, a in plan.values()) == pytest.approx(0, abs=1e-6) and plan["short"][1] < 0 < plan["long"][1]
    rows = mixing.mix(counts, targets, 1.0).toPandas()
    for lo in np.arange(0, 1, 0.25):
        part = rows[(rows.position >= lo) & (rows.position < lo + 0.25)]
        for s, (used, a) in plan.items():
            integral = lambda t, a=a: t + a * (t * t - t)
            assert part[part.source == s].tokens.sum() == pytest.approx(used * (integral(lo + 0.25) - integral(lo)), abs=120)


def test_mix_empty(spark):
    docs, targets = mix_tables(spark)
    none = mixing.token_counts(docs.limit(0))
    assert none.count() == 0 and mixing.mix(none, targets).count() == 0 and mixing.reached_shares(none, targets, mixing.mix(none, targets)).count() == 5
    assert mixing.mix(mixing.token_counts(docs), targets.limit(0)).count() == 0


# 9

_PARTS = st.one_of(
    st.text(max_size=40), st.sampled_from(["\n\n", "\n", "# Head\n", "## Sub\n", "- item ", "1. step\n", ". ", "。", "a" * 300, "漢字" * 40, "🙂" * 30, " ", "\t", "| a | b |\n", "word " * 50, "\r\n", "**x** wrote:\n", "```\n", "~~~ py\n", "<table>\n", "</table>\n", "<ul><li>", "</ul>"])
)


def checked(text, limit, overlap):
    e = encoding(VOCABULARY)
    out = pieces.cut_text(text, limit, overlap)
    n = len(e.encode_ordinary(pieces.clean(text)))
    assert bool(out) == (n > limit)
    if out:
        assert "".join(p[o:] for *_, o, p in out) == pieces.clean(text)
        for k, (size, lo, hi, o, p) in enumerate(out):
            assert size == len(e.encode_ordinary(p)) <= limit and hi > lo and text[lo - o : hi] == p and (k > 0 or o == 0)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(_PARTS, max_size=40).map("".join), st.sampled_from([(40, 8), (100, 20), (60, 0)]))
def test_round_trip(text, sizes):
    text = pieces.clean(text)
    checked(text, *sizes)


def test_natural_boundaries():
    section = lambda i: f"## Part {i}\n\n" + "\n\n".join(" ".join(["Some words of a sentence here."] * 6) for _ in range(3)) + "\n\n"
    text = "# Title\n\n" + "".join(section(i) for i in range(20))
    out = checked(text, 400, 40)
    assert all(text[lo:].startswith(("#", "Some")) for _, lo, *_ in out)
    assert sum(text[lo:].startswith("#") for _, lo, *_ in out) >= len(out) - 1
    overlaps = [len(encoding(VOCABULARY).encode_ordinary(p[:o])) for *_, o, p in out[1:]]
    assert all(25 <= x <= 45 for x in overlaps)
    assert all(text[lo - o - 1].isspace() for _, lo, _, o, _ in out[1:])


@pytest.mark.parametrize(
    ("begin", "line", "end"),
    [("```python\n", "# step {0}\nrun(x, {0})\n\n", "```\n"), ("~~~\n", "## part {0}. Then go on.\n", "~~~~\n"), ("", "| row {0} | some words. Other words |\n", ""), ("<table>\n", "<tr><td>cell {0}</td></tr>\n\n", "</table>\n"), ("<ul>\n", "<li><ul><li>item {0}</li></ul></li>\n", "</ul>\n")],
)
def test_blocks_that_fit_stay_whole(begin, line, end):
    prose = lambda n: "".join(f"Sentence number {i} of some prose, with clauses. " for i in range(n)) + "\n"
    size = lambda t: len(encoding(VOCABULARY).encode_ordinary(t))
    fitting = begin + "".join(line.format(i) for i in range(25)) + end
    large = begin + "".join(line.format(i) for i in range(200)) + end
    assert size(fitting) < 700 < 1100 < size(large)
    for before in (3, 40, 71, 97):
        text = prose(before) + fitting + prose(60) + "\n# Head\n" + fitting + prose(9) + large + fitting
        at = [i for i in range(len(text)) if text.startswith(fitting, i)]
        out = checked(text, 1000, 100)
        assert len(at) >= 3 and all(any(lo <= i and i + len(fitting) <= hi for _, lo, hi, *_ in out) for i in at)
    inner = [lo for _, lo, *_ in out if text.index(large) < lo < text.index(large) + len(large)]
    assert inner and all(text[lo - 1] == "\n" for lo in inner)


def test_long_and_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, "x" * 200_000), (5, "漢" * 30_000), (6, "word " * 100_000), (6, "word " * 2_000), (None, "y z " * 3_000), (7, "\n" * 50_000), (8, "a. " * 900)]
    out = pieces.split_oversized(spark.createDataFrame(rows, DOCS).select("*", F.lit(1).alias("piece_index"), F.lit("q").alias("TEXT"))).toPandas()
    assert out.n_tokens.max() <= 1000 and not {1, 2, 3} & set(out.doc_id.dropna())
    e = encoding(VOCABULARY)
    for doc, text in rows:
        if doc in (4, 5, 7, 8):
            assert "".join(p[o:] for p, o in zip(out[out.doc_id == doc].text, out[out.doc_id == doc].overlap_chars, strict=True)) == (text if len(e.encode_ordinary(text)) > 1000 else "")
    assert pieces.split_oversized(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError, match="limit"):
        pieces.cut_text("x", 100, 100)
