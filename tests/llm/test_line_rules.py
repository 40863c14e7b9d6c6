from collections import Counter

from docflow.llm import line_rules as lr
from tests.llm import brute


def plain(text):
    t, w = text or "", brute.WORD.findall(text or "")
    seen, dup, cover = set(), 0, set()
    for line in t.split("\n"):
        if brute.WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    for i in range(len(w) - 4):
        if c[tuple(w[i:i + 5])] > 1:
            cover.update(range(i, i + 5))
    return (len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(cover),
            len(w) < 10 or 100 * len(cover) > 20 * len(w))


def test_base_counts_on_awkward_rows(spark):
    docs = brute.docs(spark)
    got = lr.judge(docs.selectExpr("*", "text AS copy")).collect()
    assert len(got) == len(brute.ROWS)
    for r in got:
        assert plain(r["doc"]["copy"]) == tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert not (r["base_failed"] and r["kept"])
    assert lr.judge(docs.limit(0)).count() == 0


def test_keep_returns_the_kept_rows_as_they_are(spark):
    docs = brute.docs(spark)
    kept = lr.keep(docs)
    want = sorted((r["doc"]["copy"] or "", r["doc"]["doc_id"] or -1) for r in lr.judge(docs.selectExpr("*", "text AS copy")).collect() if r["kept"])
    assert kept.columns == docs.columns
    assert sorted((r["text"] or "", r["doc_id"] or -1) for r in kept.collect()) == want


def _host(n, line, own_words, source="h"):
    return [(i, f"{line}\n" + " ".join(f"own{i}w{k}" for k in range(own_words)), source) for i in range(n)]


def test_boilerplate_is_counted_per_host_and_depletes(spark):
    line = " ".join(f"menu{k}" for k in range(12))
    rows = _host(60, line, 30) + [(1000 + i, f"{line}\nx{i} y{i}", "h") for i in range(3)] + [(2000, f"{line}\nx y", "other"), (2001, line, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc"]["doc_id"]: r for r in lr.judge(docs, line_floor=20).collect()}
    assert all(got[i]["kept"] and got[i]["removed_words"] == 12 for i in range(60))
    assert all(got[1000 + i]["depleted"] and not got[1000 + i]["kept"] for i in range(3))
    assert got[2000]["kept"] and got[2000]["removed_words"] == 0 and got[2001]["kept"]


def test_copies_do_not_deplete_each_other(spark):
    lines = [" ".join(f"l{j}w{k}" for k in range(12)) for j in range(8)]
    rows = [(i, "\n".join(lines), "h") for i in range(200)]
    for i in range(200, 320):  # near copies: one word of one line differs
        near = list(lines)
        near[i % 8] = near[i % 8].replace("w5", f"z{i}")
        rows.append((i, "\n".join(near), "h"))
    rows += [(1000 + i, " ".join(f"own{i}q{k}" for k in range(40)), "h") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert all(r["kept"] for r in lr.judge(docs, line_floor=20).collect())


def _removed(spark, rows, **limits):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return {r["doc"]["doc_id"]: r for r in lr.judge(docs, **limits).collect()}


def test_unrelated_documents_with_one_dominating_line_stay_distinct(spark):
    banner = " ".join(f"banner{k}" for k in range(100))
    rows = _host(800, banner, 12) + [(1000 + i, " ".join(f"own{i}q{k}" for k in range(40)), "h") for i in range(2200)]
    got = _removed(spark, rows, line_floor=100)
    assert all(got[i]["removed_words"] == 100 and got[i]["depleted"] for i in range(800))
    assert all(got[1000 + i]["kept"] for i in range(2200))


def test_documents_that_are_nearly_pure_boilerplate_are_rejected(spark):
    for own in (1, 5, 30, 45):  # with less of their own they are never better off
        got = _removed(spark, _host(100, " ".join(f"banner{k}" for k in range(200)), own))
        assert all(r["removed_words"] == 200 and r["depleted"] and not r["kept"] for r in got.values()), own
    got = _removed(spark, _host(100, " ".join(f"banner{k}" for k in range(200)), 60))
    assert all(r["removed_words"] == 200 and r["kept"] for r in got.values())


def test_header_and_footer_over_texts_of_their_own(spark):
    head, foot = (" ".join(f"{x}{k}" for k in range(20)) for x in ("head", "foot"))
    rows = [(i, f"{head}\n" + " ".join(f"own{i}w{k}" for k in range(8 if i < 10 else 40)) + f"\n{foot}", "h") for i in range(120)]
    got = _removed(spark, rows)
    assert all(r["removed_words"] == 40 and r["kept"] == (i >= 10) for i, r in got.items())


def _plain_boilerplate(rows, share=0.1, floor=5, least_words=10, least_share=0.2):
    """doc_id -> removed words, by dictionaries."""
    host, holds, parsed = {}, {}, {}
    for i, text, source in rows:
        words = [tuple(x.translate(brute.LOW).split()) for x in (text or "").split("\n")]
        lines = Counter()
        for w in words:
            if w:
                lines[lr.line_hash([x.encode() for x in w])] += len(w)
        key = tuple(w for w in words if w)
        parsed[i] = source, key, lines, lr.picks(list(lines))
        host.setdefault(source, {}).setdefault(key, [p["line"] for p in parsed[i][3]])
        for x in lines:
            holds.setdefault((source, x), {}).setdefault(key, i)

    def different(texts):
        same = Counter((j, x) for p in texts for j, x in enumerate(p))
        return sum(1_000_000 // sorted((same[j, x] for j, x in enumerate(p)), reverse=True)[lr.SKETCHES // 2 - 1] for p in texts) / 1_000_000

    size = {s: different(list(t.values())) for s, t in host.items()}
    cand = {(s, x) for (s, x), keys in holds.items() if len(keys) > floor and len(keys) > share * size[s]}
    own = {i: sum(n for x, n in lines.items() if (s, x) not in cand) for i, (s, _, lines, _) in parsed.items()}
    bad = set()
    for s, x in cand:
        limit = max(floor, share * size[s])
        total = lambda i: sum(parsed[i][2].values())
        full = {parsed[i][1] for i in parsed if parsed[i][0] == s and x in parsed[i][2]
                and own[i] >= least_words and own[i] >= least_share * total(i)}
        rest = [[p["next"] if p["line"] == x else p["line"] for p in parsed[i][3]] for i in holds[s, x].values()]
        if len(full) > limit or different(rest) > limit:
            bad.add((s, x))
    return {i: sum(n for x, n in lines.items() if (s, x) in bad) for i, (s, _, lines, _) in parsed.items()}


def test_removed_words_equal_a_plain_version_at_production_limits(spark):
    import random

    r = random.Random(8)
    rows = []
    for source, n in (("a", 30), ("b", 150), ("c", 600)):
        menus = [" ".join(f"{source}m{j}w{k}" for k in range(r.randint(3, 40))) for j in range(6)]
        base = [" ".join(f"{source}b{j}w{k}" for k in range(12)) for j in range(7)]
        for _ in range(n):
            kind = r.random()
            lines = [m for j, m in enumerate(menus) if r.random() < 0.05 * (j + 1)]
            if kind < 0.25:  # a near copy
                lines += base
                lines[-1 - r.randint(0, 6)] = f"changed {len(rows)}"
            else:
                lines += [" ".join(f"o{len(rows)}x{j}y{k}" for k in range(r.randint(1, 9))) for j in range(r.randint(0, 4))]
            rows.append((len(rows), "\n".join(lines), source))
    rows += [(len(rows), None, "a"), (len(rows) + 1, " \n ", "b")]
    got = {i: x["removed_words"] for i, x in _removed(spark, rows).items()}
    assert got == _plain_boilerplate(rows)
    assert sum(n > 0 for n in got.values()) > 100


def test_a_large_group_of_near_copies_counts_once_in_line_and_host(spark):
    base = [[f"l{j}w{k}" for k in range(20)] for j in range(10)]
    rows = []
    for i in range(600):  # one word of one line differs
        near = [list(x) for x in base]
        near[i % 10][i % 20] = f"z{i}"
        rows.append((i, "\n".join(map(" ".join, near)), "h"))
    menu = " ".join(f"menu{k}" for k in range(30))
    rows += [(1000 + i, f"{menu}\n" + " ".join(f"own{i}q{k}" for k in range(4)), "h") for i in range(40)]
    rows += [(2000 + i, " ".join(f"own{i}r{k}" for k in range(40)), "h") for i in range(100)]
    got = _removed(spark, rows, line_floor=5)
    assert all(got[i]["kept"] and got[i]["removed_words"] == 0 for i in range(600))
    assert all(got[1000 + i]["removed_words"] == 30 and got[1000 + i]["depleted"] for i in range(40))


def test_production_limits_on_a_small_a_middling_and_a_hot_host(spark):
    sizes, rows = {"small": 20, "middling": 90, "hot": 1500}, []
    for at, (name, n) in enumerate(sizes.items()):
        share = max(6, n // 5)
        mine = _host(share, " ".join(f"{name}menu{k}" for k in range(60)), 10, name)
        mine += [(share + i, " ".join(f"{name}{i}q{k}" for k in range(40)), name) for i in range(n - share)]
        rare = " ".join(f"{name}rare{k}" for k in range(30))  # five documents: a chance repeat
        mine += [(n + i, f"{rare}\n" + " ".join(f"{name}{i}o{k}" for k in range(4)), name) for i in range(5)]
        rows += [(i + at * 100_000, t, s) for i, t, s in mine]
    for i, r in _removed(spark, rows).items():
        n = sizes[r["doc"]["source"]]
        assert r["kept"] == (i % 100_000 >= max(6, n // 5)), (i, r["removed_words"])


def test_clean_removes_the_boilerplate_lines_from_the_texts(spark):
    menu = "Menu one  two three"
    rows = [(i, f"Own{i} a b\n\n {menu.upper()} \nlast{i} {i}", "h") for i in range(20)] + [(100, menu, "other"), (101, None, "h"), (102, menu, None), (103, f"{menu}\nx\n{menu}", "h")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("doc_id", "text", "source", "1 AS doc", "2 AS gone", "3 AS host")
    out = lr.clean(docs)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == docs.columns and len(got) == 24
    assert all(got[i] == f"Own{i} a b\n\nlast{i} {i}" for i in range(20))
    assert got[100] == menu and got[101] is None and got[102] == menu and got[103] == "x"
