import pytest

from docflow.llm import license_scan as ls
from docflow.session import table
from tests.conftest import SF001
from tests.llm import brute


def plain(text, template, size=3, least=0.8):
    """Whether some run as long as the template holds enough of its shingles."""
    t, w = ls.words_of(template), ls.words_of(text)
    k = min(size, len(t))
    want = {tuple(t[i:i + k]) for i in range(len(t) - k + 1)}
    have = [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]
    return any(len(set(have[i:i + len(t) - k + 1]) & want) >= least * len(want) - 1e-9
               for i, s in enumerate(have) if s in want)


def test_every_quotation_is_found_and_nothing_else(spark):
    mit = ls.NOTICES["MIT-text"]
    rows = [(10000, f"x y {mit} z"), (10001, mit.replace("charge", "cost")), (10002, "All rights reserved. " * 3), (10003, "all rights"),
            (10004, f"{brute.LONG} {ls.NOTICES['GPL-3.0']} {brute.LONG}"), (10005, mit.split(" to ")[0])]
    docs = table(spark, SF001, "documents").select("doc_id", "text").union(
        spark.createDataFrame(rows + brute.ROWS, "doc_id bigint, text string"))
    for r in ls.scan(docs.selectExpr("*", "1 AS licenses", "2 AS doc")).collect():
        want = {name for name, text in ls.NOTICES.items() if plain(r["text"], text)}
        got = {h["license"] for h in r["licenses"]}
        assert want <= got, r["doc_id"]
        assert all(h["containment"] >= 0.8 for h in r["licenses"])
        assert all(0 <= h["start"] < h["end"] <= len(ls.words_of(r["text"])) for h in r["licenses"])
        if r["doc_id"] == 10002:
            assert [(h["start"], h["end"]) for h in r["licenses"]] == [(0, 9)]
        if r["doc_id"] in (10003, 105):
            assert not got
    assert ls.scan(docs.limit(0)).count() == 0


def test_band_settings_follow_the_guarantee():
    n = ls.bands_needed(0.6, 2, 1e-6)
    assert (1 - 0.6**2) ** n <= 1e-6 < (1 - 0.6**2) ** (n - 1)
    assert ls.bands_needed(1.0, 3, 1e-9) == 1


def test_a_template_without_words_is_an_error():
    with pytest.raises(ValueError):
        ls.Scanner({"x": " ... "})


@pytest.mark.parametrize("text, license", [
    ("It is licensed under the GNU Lesser General Public License version 2.1 or later.", "LGPL-2.1"),
    ("// SPDX-License-Identifier: MIT\nint x;", "SPDX:MIT"), ("SPDX-License-Identifier: GPL-2.0-only", "SPDX:GPL-2.0"),
    ("you can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either", "AGPL-text"),
    ("permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided", "ISC-text"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-text"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("Distributed under the Boost Software License, Version 1.0. (See the file)", "BSL-1.0")])
def test_notices_beyond_the_samples_are_found(text, license):
    scanner = ls.Scanner(ls.NOTICES)
    got = scanner.scan([f"{brute.LONG[:5000]} {text} {brute.LONG[:5000]}", text])
    assert all(license in {h["license"] for h in hits} for hits in got)
    want = {n for n, t in ls.NOTICES.items() if plain(text, t)}
    assert want <= {h["license"] for h in got[1]}


def test_bands_retrieve_and_windows_serve_a_class():
    scanner = ls.Scanner(ls.NOTICES)
    assert len(scanner.classes) < len(ls.NOTICES) / 4
    for c in scanner.classes:
        assert max(t.n for t in c.templates) <= ls.SPREAD * min(t.n for t in c.templates)
        assert c.window + c.size - 1 >= max(t.n for t in c.templates) + c.stride - 1
    more = {f"t{i}": f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i}" for i in range(300)}  # one class, one table
    assert len(ls.Scanner(more).classes) == 1
    assert [h["license"] for h in ls.Scanner(more).scan(["x alpha7 beta7 gamma7 delta7 epsilon7 y"])[0]] == ["t7"]
    both = ls.Scanner(more, rows=2).scan(["x alpha7 beta7 gamma7 delta7 epsilon7 y"])[0]
    assert [h["license"] for h in both] == ["t7"]


def test_versions_and_sister_licences_are_told_apart():
    scanner = ls.Scanner(ls.NOTICES)
    found = lambda text: {h["license"] for h in scanner.scan([text])[0]}
    gnu = "licensed under the GNU {}General Public License version {}, as you like".format
    assert found(gnu("", "2")) == {"GPL-2.0"} and found(gnu("", "3")) == {"GPL-3.0"}
    assert found(gnu("Affero ", "3")) == {"AGPL-3.0"}
    assert found(gnu("Lesser ", "2.1")) == {"LGPL-2.1"} and found(gnu("Lesser ", "3")) == {"LGPL-3.0"}
    told = "under the terms of the GNU {}General Public License as published by the Free Software Foundation".format
    assert [found(told(x)) for x in ("", "Affero ", "Lesser ")] == [{"GPL-text"}, {"AGPL-text"}, {"LGPL-text"}]
    assert found("SPDX-License-Identifier: LGPL-3.0-or-later") == {"SPDX:LGPL-3.0"}
    assert found("SPDX-License-Identifier: CC-BY-SA-4.0") == {"SPDX:CC-BY-SA-4.0"}
    grant = "Permission to use, copy, modify, and{} distribute this software for any purpose with or without fee is hereby granted".format
    assert found(grant("")) == {"ISC-text"} and found(grant("/or")) == {"0BSD-text"}
