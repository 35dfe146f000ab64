"""Headers as they stand in source files, in the comments of several languages, and SQL on them."""

import duckdb

from tessera.llm import licenses

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
FREE = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {0}General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {0}General Public License for more details."""
LIBRARY = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""
HEADERS = [("Apache-2.0", APACHE), ("GPL-3.0-or-later", FREE.format("")), ("LGPL-3.0-or-later", FREE.format("Lesser ")), ("AGPL-3.0-or-later", FREE.format("Affero ")), ("LGPL-2.1-or-later", LIBRARY)]


def commented(text):
    lines = text.split("\n")
    yield text
    for lead in ("// ", "# ", "-- ", ";; ", "    # "):
        yield "\n".join((lead + x).rstrip() for x in lines)
    yield "/*\n" + "\n".join((" * " + x).rstrip() for x in lines) + "\n */\nint main() {}"
    yield "<!--\n" + text + "\n-->"


def test_headers_in_comments(spark):
    rows = [(i, t) for i, t in enumerate(t for _, h in HEADERS for t in commented(h))]
    want = [n for n, h in HEADERS for _ in commented(h)]
    got = {r["doc_id"]: (r["licenses"], r["n_unmatched"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == [(n, 0) for n in want]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert {r[0]: (r[1], r[3]) for r in c.sql(licenses.SQL).fetchall()} == got
