import textwrap

import pytest

from clauseloom.llm import licenses


def found(spark, *texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return sorted((r.doc_id, r.license, r.matches) for r in rows)


RULES = licenses.RULES | dict(list(licenses.ALL_RULES.items())[len(licenses.RULES) :: 17])

PUBLISHED = {
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it
under the terms of the GNU General Public License as published by the Free
Software Foundation; either version 2 of the License, or (at your option)
any later version.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
General Public License version 2 as published by the Free Software Foundation.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL""",
}


@pytest.mark.parametrize("sign", ["", "// ", " * "])
def test_published_wordings(spark, sign):
    texts = ["Copyright 2020 Some One\n\n" + t for t in PUBLISHED.values()]
    texts = ["\n".join(sign + line for line in t.split("\n")) for t in texts]
    assert found(spark, *texts) == [(n, name, 1) for n, name in enumerate(PUBLISHED)]


def test_spdx_expressions(spark):
    texts = [
        "SPDX-License-Identifier: MIT OR Apache-2.0\ncode", "/* SPDX-License-Identifier: (GPL-2.0-only AND bsd-3-clause) */",
        "# spdx-license-identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "SPDX-License-Identifier: Own-1.0 OR MIT\nSPDX-License-Identifier: MIT",
        "SPDX-License-Identifier:", "SPDX-License-Identifier: MIT\nReleased under the MIT License.",
    ]
    assert found(spark, *texts) == sorted([
        (0, "MIT", 1), (0, "Apache-2.0", 1), (1, "GPL-2.0", 1), (1, "BSD-3-Clause", 1), (2, "GPL-2.0-or-later WITH classpath-exception-2.0", 1),
        (3, "MIT", 2), (5, "MIT", 2),
    ])


def test_common_phrases(spark):
    texts = ["This project is licensed under the MIT License.", "Licensed under the MIT license (see LICENSE).", "Licensed under the Apache License, Version 2.0"]
    assert found(spark, *texts) == [(0, "MIT", 1), (1, "MIT", 1), (2, "Apache-2.0", 1)]


@pytest.mark.parametrize("sign", ["", "# ", " * "])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_wrapped_texts(spark, sign, end):
    texts = []
    for rule in RULES:
        wrapped = [textwrap.wrap(licenses.ALL_SENTENCES[x] + ".", 40) for x in rule]
        texts.append(f"{end}{sign}{end}".join(end.join(sign + line for line in part) for part in wrapped))
    assert found(spark, *texts) == [(n, name, 1) for n, name in enumerate(RULES.values())]


def test_lines_without_marks_still_match(spark):
    assert found(spark, "Some title\nReleased under the\nMIT License\nAll rights reserved\nmore text") == [
        (0, "All-Rights-Reserved", 1), (0, "MIT", 1)]
    assert found(spark, "Not released under the\n\nMIT License.", "It is not released under the MIT License.") == []


def test_odd_separators_and_identifiers(spark):
    texts = ["All  rights  reserved", "All rights-reserved", "All\trights\u00a0reserved", "all rights\nreserved."]
    assert found(spark, *texts) == [(n, "All-Rights-Reserved", 1) for n in range(4)]
    assert found(spark, "// SPDX-License-Identifier: MPL-2.0\nint x;", "# SPDX-License-Identifier: MIT") == [(0, "MPL-2.0", 1), (1, "MIT", 1)]


def test_all_tables(spark):
    assert all(any(a in s for a in licenses.ANCHORS) for s in licenses.ALL_SENTENCES.values()) and not any(" " in a for a in licenses.ANCHORS)
    assert len(set(licenses.ALL_SENTENCES.values())) == len(licenses.ALL_SENTENCES) > 300
    assert all(set(rule) <= set(licenses.ALL_SENTENCES) for rule in licenses.ALL_RULES)
    clashing = spark.createDataFrame([(1, "Released under the MIT License.", "x", 2, ["y"])], "doc_id long, text string, license string, matches int, found array<string>")
    assert [tuple(r) for r in licenses.scan(clashing).collect()] == [(1, "MIT", 1)]


def test_sql_on_published_wordings(spark, tmp_path):
    import duckdb

    from clauseloom.llm import queries
    from tests.oracle import compare

    texts = [*PUBLISHED.values(), "SPDX-License-Identifier: MIT OR Apache-2.0 WITH LLVM-exception\nAll rights\nreserved", "All rights-reserved. Nothing", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    assert compare(licenses.scan(docs), con, queries.ORACLES["op7_licenses"]) == []
