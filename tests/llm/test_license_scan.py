from tests.llm import cases
from tsudoi.llm import license_scan as L

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""


def found(spark, rows):
    return {r.doc_id: (list(r.sentences), list(r.licenses), r.unmatched) for r in L.report(cases.docs(spark, rows)).collect()}


def test_licences(spark):
    got = found(spark, [
        (1, MIT), (2, GPL), (3, "Prose before\nLicensed under the Apache License, Version 2.0.\nProse after."), (4, "Released under the MIT License. Licensed under CC BY-NC 4.0."),
        (5, "No licence here, a license is mentioned."), (6, "You may not use this file except in compliance with the License."), (7, "MIT License\nMIT License\nfree  Software"),
        (8, "Licensed under the Apache License, Version 2.0; you may obtain a copy of the License at\n http://x")])
    assert got[1] == (["mit_name", "mit_grant", "mit_notice", "as_is_mit", "no_liability_mit"], ["MIT"], 0)
    assert got[2] == (["gpl_free", "gpl3_terms", "gpl_hope", "gpl_hope", "gpl_see"], ["GPL-3.0-or-later"], 0)
    assert got[3] == (["apache2_name"], ["Apache-2.0"], 0) and got[4] == (["mit_name", "ccbync4_name"], ["MIT", "CC-BY-NC-4.0"], 0)
    assert got[5] == ([], [], 0) and got[6] == (["apache2_use"], [], 1) and got[7] == (["mit_name", "mit_name"], ["MIT"], 0)
    assert got[8][1] == ["Apache-2.0"]


def test_edges(spark):
    rows = cases.odd_rows()
    out = L.report(cases.docs(spark, rows)).collect()
    assert len(out) == len(rows) and not any(r.sentences or r.licenses or r.unmatched for r in out)
    assert L.report(cases.docs(spark, [])).count() == 0


def test_tables_fit_together():
    known = [s for every in L.SENTENCES.values() for s in every]
    assert len(known) == len(set(known)) and all(any(a in s for a in L.ANCHORS) for s in known)
    assert all(i in L.SENTENCES for _, ids in L.RULES for i in ids)
    for n, (_, ids) in enumerate(L.RULES):  # no rule is hidden by an earlier, shorter one
        assert not any(L.pattern(early) in L.pattern(ids) for _, early in L.RULES[:n])


def test_colons_and_comment_headers(spark):
    header = "".join(f" * {line}".rstrip() + "\n" for line in MIT.splitlines()[2:])
    got = found(spark, [(1, "// SPDX-License-Identifier: MIT\n#include <x>"), (2, "Name: x\nLicense: Apache-2.0\nVersion: 1"), (3, f"/*\n{header} */\nint x;"),
                        (4, "Copyright 2020 X\nLicensed under the\nMIT License")])
    assert got[1] == (["mit_name"], ["MIT"], 0) and got[2] == (["apache2_name"], ["Apache-2.0"], 0)
    assert got[3] == (["mit_grant", "mit_notice", "as_is_mit", "no_liability_mit"], ["MIT"], 0) and got[4] == (["mit_name"], ["MIT"], 0)


def test_sql_agrees(spark):
    """The SQL of the query on texts with SPDX lines, wrapped sentences, comment headers and repeated names."""
    import duckdb
    import pandas as pd

    from tsudoi.llm.queries import ORACLES
    header = "".join(f" * {line}".rstrip() + "\n" for line in MIT.splitlines()[2:])
    rows = [(1, "// SPDX-License-Identifier: MIT\n#include <x>"), (2, "Name: x\nLicense: Apache-2.0\nVersion: 1"), (3, f"/*\n{header} */\nint x;"), (4, "Copyright 2020 X\nLicensed under the\nMIT License"),
            (5, MIT), (6, GPL), (7, "MIT License\nMIT License\nThis program is free software: you can redistribute it"), (8, None), (9, ""), (10, "All rights\nreserved. Licence: MIT License: all rights reserved"),
            (11, "Licensed under the Apache License, Version 2.0; you may obtain a copy of the License at\n http://x"), (12, "MIT\n\nLicense:\n\n \tApache-2.0")]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = found(spark, rows)
    want = {i: (s.split(",") if s else [], l.split(",") if l else [], u) for i, s, l, u in con.execute(ORACLES["op7_license_scans"]).fetchall()}
    assert got == want and sum(bool(s) for s, _, _ in want.values()) >= 8
