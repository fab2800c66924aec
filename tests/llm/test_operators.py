"""The training-data operators on awkward rows, and against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pixelweft.llm import decontamination, htmltext, linedrop, mixing, ngram, quality, sharding, simhash, suffixdedup, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
EXTRA = "size long, reps int, shard int, slot long, fp long, words string, h long, th long, line string, target double, key string, row int"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def awkward():
    """(doc_id, text, source): nulls, empty, blank and very long texts, ties, repeated rows and ids."""
    long = words(30_000, 1)
    return [
        (1, "Alpha beta gamma delta epsilon zeta eta theta", "b"), (2, None, None), (3, "", "a"), (4, " \n\t\n ", "a"), (None, "no id here at all, none", "b"), (None, None, None),
        (5, long, "c"), (6, long, "c"), (7, long + " end", None), (8, "x", "a"), (8, "x", "a"), (8, "another text under the same id", "a"), (9, "ÀÉ ßtraße 東京 \U0001F600 \x00 nul", "é"),
        (10, words(300, 2), "b"), (11, words(300, 2)[:900] + " " + words(100, 3), "b"), (-5, words(300, 2), "b"), (1 << 40, words(120, 4) + "\n" + words(20, 5), "a"),
    ]


def frame(spark, rows=None, extra=True):
    df = spark.createDataFrame(awkward() if rows is None else rows, "doc_id long, text string, source string")
    if extra:
        for c in EXTRA.split(", "):
            name, kind = c.split()
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.withColumn("lang", F.lit("en"))


def labels(spark, rows=((1, 0), (5, 0), (10, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, toxic int")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


REPORTS = {
    "op1": lambda s, d: sharding.shard_report(d),
    "op2": lambda s, d: toxicity.severity_report(d, labels(s)),
    "op3": lambda s, d: linedrop.recurring_lines(d, 2),
    "op4": lambda s, d: ngram.score_report(d),
    "op6": lambda s, d: quality.judge(d, max_docs=1),
    "op7": lambda s, d: suffixdedup.remove_repeats(d),
    "op8": lambda s, d: mixing.mix_plan(d),
    "op10": lambda s, d: simhash.near_duplicate_report(d),
}
STAGES = {
    "toxicity": lambda s, d: toxicity.reject_toxic(d, labels(s)),
    "lines": lambda s, d: linedrop.drop_lines(d, 2),
    "quality": lambda s, d: quality.keep_good(d),
    "dedup": lambda s, d: simhash.keep_one(d),
    "decontamination": lambda s, d: decontamination.remove_contaminated(d, items(s, [(1, words(300, 2)), (2, None), (3, "short")])),
    "mixing": lambda s, d: mixing.mix(d),
}


@pytest.mark.parametrize("name", REPORTS)
def test_one_row_for_each_row(spark, name):
    d = frame(spark)
    got = [r.doc_id for r in REPORTS[name](spark, d).select("doc_id").collect()]
    assert collections.Counter(got) == collections.Counter(r[0] for r in awkward())


@pytest.mark.parametrize("name", [*REPORTS, *STAGES])
def test_empty_tables(spark, name):
    assert {**REPORTS, **STAGES}[name](spark, frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(spark, name):
    d = frame(spark)
    out = STAGES[name](spark, d)
    assert out.columns == d.columns and out.dtypes == d.dtypes
    assert out.count() >= 1


def test_sharding_moves_keys_into_the_new_shard_only(spark):
    d = spark.createDataFrame([(i, f"t{i % 3}", "s") for i in range(3000)], "doc_id long, text string, source string")
    rows = sharding.shard_report(d).collect()
    assert {r.grown_shard for r in rows if r.shard != r.grown_shard} == {16}
    per = collections.defaultdict(list)
    for r in rows:
        per[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in per.values()) and len(per) == 16
    assert all(r.text_crc32 == zlib.crc32(f"t{r.doc_id % 3}".encode()) for r in rows)
    heavy = sharding.assign_shards(d, "doc_id", [(0, 1.0), (1, 3.0)]).groupBy("shard").count().collect()
    assert 0.7 < max(r["count"] for r in heavy) / 3000 < 0.8


def test_severity_has_ordered_grades():
    rng = random.Random(0)
    base = [words(40, k) for k in range(400)]
    grade = [k % 4 for k in range(400)]
    texts = [t + " " + " ".join(rng.choices(["vile", "scum"], k=3 * g)) for t, g in zip(base, grade, strict=True)]
    m = toxicity.train(texts[:300], grade[:300])
    assert m.thresholds == sorted(m.thresholds) and len(m.thresholds) == 3
    by = [np.mean([m.severity(t) for t, g in zip(texts[300:], grade[300:], strict=True) if g == k]) for k in range(4)]
    assert by[0] < 0.3 and by[0] < by[1] < by[2] < by[3]
    assert toxicity.Model().severity("any") == 0 and toxicity.train([], []).thresholds == []


def test_toxic_documents_are_held_out_and_found(spark):
    rng = random.Random(1)
    rows = [(i, words(60, i) + (" scum idiot " + rng.choice(["trash", "moron"]) if i % 5 == 0 else ""), "s") for i in range(800)]
    d, lab = frame(spark, rows), labels(spark, [(i, int(i % 5 == 0)) for i in range(500)])
    got = {r.doc_id: r.toxic for r in toxicity.severity_report(d, lab).collect()}
    right = [got[i] == (i % 5 == 0) for i in range(500, 800)]
    assert np.mean(right) > 0.98


def test_without_labels_nothing_is_toxic(spark):
    for rows in ((), ((1, None), (5, None)), ((1, 0), (5, 0)), ((77, 1),)):
        got = toxicity.severity_report(frame(spark), labels(spark, rows)).collect()
        assert len(got) == len(awkward()) and not any(r.toxic or r.severity for r in got)
    assert toxicity.reject_toxic(frame(spark), labels(spark, ())).count() == len(awkward())


def test_labels_above_one_are_grades(spark):
    rng = random.Random(0)
    rows = [(k, words(40, k) + " " + " ".join(rng.choices(["vile", "scum"], k=3 * (k % 4))), "s") for k in range(240)]
    got = {r.doc_id: r.severity for r in toxicity.severity_report(frame(spark, rows), labels(spark, [(k, k % 4) for k in range(200)])).collect()}
    mean = [np.mean([got[k] for k in range(200, 240) if k % 4 == g]) for g in range(4)]
    assert mean == sorted(mean) and mean[0] < 0.5 < mean[2] - mean[0]


def test_empty_benchmarks_find_nothing(spark):
    for rows in ([], [(1, None), (None, words(20, 1))], [(2, "too short")]):
        assert decontamination.contaminated(frame(spark), items(spark, rows)).count() == 0
        assert decontamination.remove_contaminated(frame(spark), items(spark, rows)).count() == len(awkward())


def test_edited_items_are_found(spark):
    """Windows whose shingles are similar by 0.8 or more, with words changed at an end or in the middle."""
    rng, bench = random.Random(3), [(k, words(random.Random(k).randint(13, 60), 7000 + k)) for k in range(60)]
    rows = []
    for k, t in bench:
        for way in range(4):
            w = t.split()
            many = max(1, len(w) // 18)
            if way == 0:
                w[-many:] = words(many, 100 * k + 1).split()
            elif way == 1:
                w[:many] = words(many, 100 * k + 2).split()
            elif way == 2:
                w[rng.randrange(len(w))] = words(1, 100 * k + 3)
            rows.append((10 * k + way, f"{words(30, 9 * k)} {' '.join(w)} {words(30, 9 * k + 1)}", "s"))

    def similar(i, k):
        sh = lambda w: {tuple(w[j : j + 5]): sum(map(len, w[j : j + 5])) for j in range(len(w) - 4)}
        x, w, best = bench[k][1].split(), rows[i][1].split(), 0.0
        b = sh(x)
        for at in range(len(w) - len(x) + 1):
            a = sh(w[at : at + len(x)])
            best = max(best, sum(a[g] for g in a if g in b) / sum((a | b).values()))
        return best >= 0.8

    want = {(rows[i][0], k) for k in range(60) for i in range(4 * k, 4 * k + 4) if similar(i, k)}
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(spark, rows), items(spark, bench)).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 120


def test_line_templates_generalise_fields(spark):
    prose = [words(12, 100 + i) for i in range(30)]
    rows = [(i, f"{prose[i]}\nPosted by user{i} on 2024-01-{i % 28 + 1} at {i}:00 from the site\nWe thank {words(1, i)} for the kind and helpful comment today", "s") for i in range(30)]
    got = {r.doc_id: (r.n_lines, r.dropped) for r in linedrop.recurring_lines(frame(spark, rows), 10).collect()}
    assert all(n == 3 and 0 not in dropped and 1 in dropped for n, dropped in got.values())
    assert sum(2 in dropped for _, dropped in got.values()) >= 25
    kept = {r.doc_id: r.text for r in linedrop.drop_lines(frame(spark, rows), 10).collect()}
    assert all(t.startswith(prose[i]) and "Posted" not in t for i, t in kept.items())


def test_unlike_short_lines_with_two_words_in_common_stay(spark):
    rows = [(i, "She said " + words(3, 700 + i) + f"\nWe thank {words(1, i)} so much", "s") for i in range(40)]
    assert {tuple(r.dropped) for r in linedrop.recurring_lines(frame(spark, rows), 10).collect()} == {(1,)}
    assert {len(c) for n in range(1, 8) for c in linedrop.choices(n) if 8 * len(c) < 5 * n} == set()


def test_templates_are_not_left_in_fragments(spark):
    rows = [(i, f"This article was {words(1, 5000 + i)} by our {words(1, 9000 + i // (2 + i % 8))} friend at noon", "s") for i in range(400)]
    assert {tuple(r.dropped) for r in linedrop.recurring_lines(frame(spark, rows), 10).collect()} == {(0,)}


def test_line_templates_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "x y " + " ".join(rng.choices("abc", [6, 2, 1], k=1 + i % 8)), "s") for i in range(500)]
    hashes = {r.doc_id: r.line for r in linedrop.lines_of(frame(spark, rows)).collect()}
    tokens, many = {hashes[i]: t.split()[2:] for i, t, _ in rows}, collections.Counter(hashes.values())

    def agree(a, b):
        a, b = tokens[a], tokens[b]
        return len(a) == len(b) and 8 * sum(x == y for x, y in zip(a, b, strict=True)) >= 5 * len(a)

    leads, template = [], {}
    for a in sorted(tokens, key=lambda h: (-many[h], h)):
        template[a] = next((b for b in leads if agree(a, b)), a)
        leads += [a] if template[a] == a else []
    assert 8 < len(leads) < len(tokens) / 2
    got = {r.line: r.template for r in linedrop.templates(linedrop.distinct_lines(linedrop.lines_of(frame(spark, rows)))).collect()}
    assert got == {a: b for a, b in template.items() if a != b}


def test_lm_base_counts_and_held_out_score(spark):
    text = {i: " ".join(random.Random(i % 40).choices(["the", "cat", "sat", "on", "a", "mat", "dog"], k=60)) for i in range(300)} | {300: "", 301: None}
    d = frame(spark, [(i, t, "s") for i, t in text.items()])
    rows = ngram.score_report(d).collect()
    c = collections.Counter()
    tok = {i: [*WORD.findall((t or "").encode().lower()), b"\n"] for i, t in text.items()}
    for i, t in tok.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(t)
    n, v = sum(c.values()), len(c)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.train_tokens == n
        assert r.n_tokens == len(tok[r.doc_id]) and r.n_known == sum(w in c for w in tok[r.doc_id])
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tok[r.doc_id]))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_probabilities_match_counts_and_sum_to_one(spark):
    """Every context's probabilities over all words and one unknown word, by the trie, against dictionaries."""
    vocab = ["a", "b", "c", "d", "e"]
    texts = [" ".join(random.Random(i).choices(vocab, [5, 4, 3, 2, 1], k=12)) for i in range(120)]
    trie = ngram.train(spark.createDataFrame([(t,) for t in texts], "text string"), 3, 2, parts=3)
    tok = [[*t.split(), None] for t in texts]
    uni, bi, tri = (collections.Counter(tuple(t[k : k + n]) for t in tok for k in range(len(t) - n + 1)) for n in (1, 2, 3))
    bi, tri = ({k: c for k, c in x.items() if c >= 2} for x in (bi, tri))
    total, v = sum(uni.values()), len(uni)

    def p(context, w):
        if not context:
            return (uni[(w,)] + 1) / (total + v + 1)
        table, below = (bi, uni) if len(context) == 1 else (tri, bi)
        seen = {k: c for k, c in table.items() if k[:-1] == context}
        if not seen:
            return p(context[1:], w)
        weight = below[context]
        left = 1 - sum(c - 0.75 for c in seen.values()) / weight
        return max(seen.get((*context, w), 0.75) - 0.75, 0) / weight + left * p(context[1:], w)

    ends = [*vocab, None, "unknown"]
    for context in (("a",), ("a", "b"), ("e", "e")):
        assert sum(p(context, w) for w in ends) == pytest.approx(1)
    import pyarrow as pa

    probe = ["a b c", "e e d a", "zz a b", "a zz b", ""]
    h, text = ngram.tokens(pa.array(probe))
    got = trie.score(h, text, len(probe))["score"]
    for t, s in zip(probe, got, strict=True):
        w = [*t.split(), None]
        want = sum(np.log10(p(tuple(w[max(0, k - 2) : k]), x)) for k, x in enumerate(w))
        assert s == pytest.approx(want, abs=0.02 * len(w))


def test_lm_report_counts_what_training_has_once(spark):
    """Each pair and triple of the training rows is in the model of the report, also those seen once."""
    rows = [(i, " ".join(random.Random(i).choices([f"w{k}" for k in range(60)], k=25)), "s") for i in range(60)]
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    tok = [[*t.split(), None] for _, t, _ in learnt]
    bi, tri = (collections.Counter(tuple(t[k : k + n]) for t in tok for k in range(len(t) - n + 1)) for n in (2, 3))
    assert min(bi.values()) == min(tri.values()) == 1
    trie = ngram.train(frame(spark, learnt), 3, 1)
    assert (trie.levels[1].n, trie.levels[2].n) == (len(bi), len(tri))
    want = {r.doc_id: r.score for r in ngram.score(frame(spark, rows), trie, ["doc_id"]).collect()}
    assert {r.doc_id: r.score for r in ngram.score_report(frame(spark, rows)).collect()} == pytest.approx(want)


def test_html_layout():
    page = """<html><head><title>T</title><style>.gone{display:none}</style></head><body><h1>Head</h1><p>one <b>two<p>three &amp; <i>four</i>
    <ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul><div class="gone">x</div><p hidden>y</p><p style="display: none">z</p><script>var a="<p>no";</script>
    <table><tr><th>n<th>name<tr><td>1<td>long name<tr><td>22<td>x</table><pre>k
  l</pre><p>end<br>of it<!-- c --></body></html>"""
    assert htmltext.html_to_text(page) == "Head\n\none two\n\nthree & four\n\n- a\n- b\n  3. c\n  4. d\n\nn   name\n1   long name\n22  x\n\nk\n  l\n\nend\nof it"
    assert htmltext.html_to_text(None) == htmltext.html_to_text("") == ""
    assert htmltext.html_to_text("<div>" * 5000 + "deep") == "deep"
    assert htmltext.html_to_text("<td>a</li></p>b") == "a b" or "b" in htmltext.html_to_text("<td>a</li></p>b")


def test_html_shows_what_browsers_show():
    show = htmltext.html_to_text
    assert show("<p>pick <select><option>one<option selected>two</select> <textarea>shown</textarea> on") == "pick two shown on"
    assert show("<select multiple><option>one<option>two</select>") == "one\ntwo"
    assert show("<svg><title>no</title><text>drawn</text></svg>") == "drawn"
    stray = "<table><thead><th>A<th>B</thead>loose<tr><form><td>1<td>2</form><b>bold</b><tbody><td>x</td><td>y</table>after"
    assert sorted(show(stray).split()) == sorted("A B loose 1 2bold x y after".split())
    assert show("<table><tr><td rowspan=2>long cell<td>b<tr><td>c<tr><td colspan=2>wide<td>z</table>") == "long cell  b\n           c\nwide          z"


def test_html_of_large_tables_stays_small():
    long = "<table><tr><td>" + "word " * 2000 + "<td>x</tr>" + "".join(f"<tr><td>r{i}<td>v{i}</tr>" for i in range(500)) + "</table>"
    text = htmltext.html_to_text(long)
    assert len(text) < 2 * len(long) and "r499  v499" in text
    wide = "<table><tr>" + "<td>c" * 3000 + "</tr>" + ("<tr>" + "<td colspan=1000>" * 3 + "<td>x</tr>") * 500 + "</table>"
    text = htmltext.html_to_text(wide)
    assert len(text) < 2 * len(wide) and text.count("x") == 500 and text.count("c") == 3000


def test_html_lines_of_a_table_dont_depend_on_its_size():
    head = "<table><tr>" + f"<td>{'h' * 30}" * 4 + "</tr>"
    sparse = lambda n: htmltext.html_to_text(head + "<tr><td colspan=3><td>x</tr>" * n + "</table>").split("\n")
    assert sparse(3)[1] == sparse(300)[1] == sparse(300)[-1] == " " * 96 + "x"
    far = htmltext.html_to_text("<table><tr>" + f"<td>{'h' * 30}" * 9 + "</tr><tr><td colspan=7><td>x<td>y</tr></table>").split("\n")
    assert far[1] == " " * 124 + "x" + " " * 124 + "y"


@pytest.mark.parametrize("seed", range(30))
def test_html_keeps_every_visible_word_once(seed):
    rng = random.Random(seed)
    tags = "p div ul ol li table tr td th thead tbody b i blockquote dl dt dd h1 form caption".split()
    out, n = [], 0
    for _ in range(200):
        kind = rng.random()
        if kind < 0.45:
            out.append(f"<{rng.choice(tags)}>")
        elif kind < 0.7:
            out.append(f"</{rng.choice(tags)}>")
        else:
            out.append(f" w{n}x ")
            n += 1
    got = re.findall(r"w\d+x", htmltext.html_to_text("".join(out)))
    assert sorted(got) == sorted(f"w{k}x" for k in range(n))


def test_repeated_rows_are_mixed_as_planned(spark):
    rows = [(k // 2 if k < 300 else None, words(10, k // 2), "ab"[k % 4 // 2]) for k in range(400)] + [(k, words(40, k), "c") for k in range(1000, 1030)]
    docs = frame(spark, rows)
    plan = collections.Counter()
    for r in mixing.mix_plan(docs).collect():
        plan[r.doc_id, r.source] += r.taken
    got = collections.Counter()
    for r in mixing.mix(docs).collect():
        got[r.doc_id, r.source] += len(r.text.split())
    assert got == +plan and any(plan[k] % 20 for k in plan)


def test_rows_with_one_id_are_judged_apart(spark):
    good = words(60, 1)
    rows = [(1, good, "h"), (1, "too short", "h"), (None, good, "h"), (None, None, "h"), (1, good, "h")]
    kept = quality.keep_good(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.text == good) for r in kept) == [(False, True), (False, True), (True, True)]


def test_slots_do_not_change_between_runs(spark):
    rows = [(k % 7 if k % 3 else None, words(5, k), "s") for k in range(300)]

    def slots(rows, parts):
        d = frame(spark, rows).repartition(parts)
        d = sharding.number_slots(sharding.assign_shards(d, "doc_id", [(i, 1.0) for i in range(4)]), "doc_id", ("text", "source"))
        return sorted((r.shard, r.slot, r.text) for r in d.collect())

    once = slots(rows, 2)
    assert once == slots(rows[::-1], 5)
    per = collections.defaultdict(list)
    for shard, slot, _ in once:
        per[shard].append(slot)
    assert all(v == list(range(len(v))) for v in per.values())


def test_html_table(spark):
    p = spark.createDataFrame([(1, None), (2, ""), (None, "<p>x"), (2, "<p>y")], "page_id long, html string").withColumn("text", F.lit(1))
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in htmltext.extract_report(p).collect()) == [(0, "x", 1), (1, "", 0), (2, "", 0), (2, "y", 1)]


def test_quality_limits(spark):
    rows = [(i, f"{words(40, i)}\nShared footer LINE of the host\n{words(30, i + 500)}", f"h{i % 2}") for i in range(20)] + [(99, "shared footer line  of the host\n" * 2 + words(3, 9), "h0"), (100, words(5, 8) + "\n" + words(5, 8), "h0")]
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows), max_docs=5, min_words=1).collect()}
    assert got[0].kept and got[0].n_removed_words == 6 and got[1].n_removed_words == 6
    assert got[99].n_removed_words == 12 and not got[99].kept and got[100].n_dup_lines == 1 and got[100].base_failed


@pytest.mark.parametrize("seed", [0, 1])
def test_suffix_dedup_against_all_windows(spark, seed):
    rng = random.Random(seed)
    pool = [words(25, k) for k in range(6)]
    rows = [(i * 3 - 20, " ".join(rng.choice([*pool, words(10, 1000 + 50 * seed + i)]) for _ in range(rng.randint(0, 6))) + rng.choice(["", "é東", "aaaa" * 30]), "s") for i in range(40)]
    rows += [(500, "aaaa" * 40, "s"), (500, "aaaa" * 40, "s"), (501, "aaaa" * 40, "s"), (502, None, "s")]
    got = collections.defaultdict(list)
    for r in suffixdedup.remove_repeats(frame(spark, rows), shard_bytes=3000).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    first = {}
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        assert (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()) in got[i]


def test_loser_tree_shares_prefixes():
    rng = random.Random(5)
    keys = [sorted(bytes(rng.choices(b"ab", k=12)) for _ in range(rng.randint(0, 30))) for _ in range(7)]
    lcp = lambda a, b: next((k for k in range(12) if a[k] != b[k]), 12)
    runs = [([0, *[lcp(a, b) for a, b in zip(r, r[1:], strict=False)]][: len(r)], r) for r in keys]
    out = [(keys[s][i], a) for s, i, a in suffixdedup.loser_tree(runs)]
    assert [k for k, _ in out] == sorted(k for r in keys for k in r)
    assert all(a == lcp(p, k) for (p, _), (k, a) in zip(out, out[1:], strict=False))


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, words(rng.choice([5, 20, 60]), i), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    got = mixing.mix_plan(frame(spark, rows)).collect()
    total = sum(r.size for r in got)
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        by[r.source][0] += r.size
        by[r.source][1] += r.taken
        by[r.source][2] = r.target
        assert r.taken <= 3 * r.size and r.source_size > 0
    assert sum(t for _, _, t in by.values()) == pytest.approx(total)
    assert all(t <= 3 * s + 1e-6 and abs(k - t) <= 60 for s, k, t in by.values())
    assert sorted(map(tuple, mixing.mix_plan(frame(spark, rows[::-1])).select("doc_id", "taken").collect())) == sorted((r.doc_id, r.taken) for r in got)
    mixed = mixing.mix(frame(spark, rows)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == {r.doc_id: r.reps for r in got if r.reps}


def test_decontamination_against_brute_force(spark):
    bench = [(k, words(random.Random(k).randint(6, 50), 9000 + k)) for k in range(12)] + [(50, "too short"), (51, None), (None, words(20, 1))]
    rows = [(i, words(80, i), "s") for i in range(40)] + [(100 + k, f"{words(30, 200 + k)} {t.upper()}! {words(30, 300 + k)}", "s") for k, t in bench[:12]]
    rows += [(200, bench[3][1], "s"), (201, " ".join(bench[11][1].split()[:-1] + ["other"]), "s"), (202, None, "s"), (None, bench[4][1], "s")]
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(spark, rows), items(spark, bench)).collect()}
    clean = lambda t: re.sub(r"[^\w\s]", "", (t or "").lower()).split()
    sh = lambda w: collections.Counter({tuple(w[i : i + 5]): w.count("") + 1 for i in range(len(w) - 4)})
    want = set()
    for i, t, _ in rows:
        w = clean(t)
        for k, b in bench:
            x = clean(b)
            if k is None or len(x) < 5:
                continue
            for a in range(max(1, len(w) - len(x) + 1)):
                p, q = sh(w[a : a + len(x)]), sh(x)
                weigh = lambda c: sum(sum(map(len, s)) for s in c)
                if p and weigh(p & q) >= 0.8 * weigh(p | q):
                    want.add((i, k))
    assert got == want and len(got) >= 14


def test_fingerprints_and_components_against_brute_force(spark):
    base = [words(400, k) for k in range(8)]
    rows = [(i, " ".join(w if random.Random(i * 1000 + j).random() > 0.002 else "zz" for j, w in enumerate(base[i % 8].split())), "s") for i in range(160)] + [(500, "", "s"), (501, None, "s"), (502, "one two", "s")]

    def fp(t):
        w = WORD.findall((t or "").encode().lower())
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {i: fp(t) for i, t, _ in rows}
    root = {i: i for i in fps}
    change = True
    while change:
        change = False
        for a in fps:
            low = min(root[b] for b in fps if bin(fps[a] ^ fps[b]).count("1") <= 3)
            if low < root[a]:
                root[a], change = low, True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicate_report(frame(spark, rows)).collect()}
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in fps}
    assert len(set(root.values())) < 100


def test_one_of_each_similar_group_stays_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(1000, "", "s"), (1001, None, "s"), (1002, "one two", "s"), (1003, "ONE  two", "s"), (1004, "one two three", "s")]
    for k, (n, rate, copies) in enumerate([(12, 0.02, 12), (40, 0.01, 15), (150, 0.02, 15), (400, 0.02, 15), (400, 0.004, 80), (3000, 0.022, 8), (60, 0.03, 15)]):
        base = words(n, 50 + k).split()
        for _ in range(copies):
            text = [w if rng.random() > rate else words(1, rng.random()) for w in base]
            rows.append((len(rows), (" ".join(text) + ("\nthe same closing passage " * 3 if k % 2 else "")).title(), "s"))
    rows += [(2000 + i, words(150, 900 + i) + " the same closing passage of many documents here", "s") for i in range(30)]

    def shingles(t):
        w = WORD.findall((t or "").lower().encode())
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t, _ in rows}
    root = {i: i for i in sets}
    near = {a: [b for b in sets if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))] for a in sets}
    change = True
    while change:
        change = False
        for a in sets:
            low = min(root[b] for b in near[a])
            if low < root[a]:
                root[a], change = low, True
    assert {r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect()} == set(root.values())
    assert 30 < len(set(root.values())) < 120


def test_dense_groups_link_like_brute_force():
    rng = np.random.default_rng(1)
    x = np.unique(np.concatenate([b ^ sum(np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64) for _ in range(3)) for b in rng.integers(0, 1 << 63, 3, dtype=np.uint64)]))
    a, b = simhash.link_dense(x, 3, 1 << 18)
    c, d = simhash.link_group(x, 3)
    assert dict(zip(a, b, strict=True)) == dict(zip(c, d, strict=True))


def test_crowded_buckets_link_like_others(spark):
    rng = np.random.default_rng(4)
    x = np.unique(np.bitwise_xor.accumulate(np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))
    x = np.unique(np.append(x, rng.integers(0, 1 << 63, 100, dtype=np.uint64))).view(np.int64)
    fps = spark.createDataFrame([(int(v),) for v in x], "fp long")
    parts = []
    for crowd in (1 << 30, 8):
        root = {int(v): int(v) for v in x}
        for r in simhash.links(fps, 3, crowd).collect():
            a, b = root[r.a], root[r.b]
            root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
        parts.append(root)
    assert parts[0] == parts[1] and 100 < len(set(parts[0].values())) < len(x)


def test_thresholds_by_dynamic_programming():
    for n in (10**4, 10**7, 10**10):
        cost, ts = min(simhash.allocate([n * n / 2.0 ** (64 // m)] * m, [64 // m] * m, n, 3) for m in (2, 3, 4))
        assert sum(t + 1 for t in ts) == 4 and cost > 0
    assert len(ts) == 2  # many fingerprints: wide partitions
    assert simhash.allocate([1e15, 1.0, 1.0], [21, 21, 22], 10**4, 3)[1][0] == -1  # a partition that all share is left out
