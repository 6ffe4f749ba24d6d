"""Each rule on the licence text it names: as published, wrapped anew, and commented."""

import textwrap

import pytest

from spanwise.llm import licences

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of Example Works, Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
TEXTS = {
    "GPL-3.0-or-later": GPL.replace("version 2", "version 3"),
    "MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "GPL-2.0-or-later": GPL, "Apache-2.0": APACHE,
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def shapes(text):
    narrow = "\n\n".join(textwrap.fill(" ".join(p.split()), 43) for p in text.split("\n\n"))
    for t in (text, narrow, text.replace("\n", "\r\n")):
        yield t
        for mark in ("# ", "// ", " * ", "    "):
            yield "int x;\n" + "\n".join((mark + line).rstrip() for line in t.split("\n")) + "\nint y;"


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_real_texts_are_named(spark, name):
    made = list(shapes(TEXTS[name]))
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r.doc_id: (r.licences, r.n_matches) for r in licences.scan(df).collect()}
    assert got == {k: (name, 1) for k in range(len(made))}


def test_sql_finds_the_same(spark):
    """Whole texts, wrapped and commented, one after another and sentences that repeat."""
    import duckdb

    texts = [t for name in sorted(TEXTS) for t in shapes(TEXTS[name])]
    texts += [MIT + "\n\n" + BSD3, BSD2 + "\n" + BSD2, "Redistributions of source code must retain the above copyright notice. " * 3, None, ""]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    cur = con.execute(licences.ORACLE)
    columns = [c[0] for c in cur.description]
    want = {r[0]: dict(zip(columns, r, strict=True)) for r in cur.fetchall()}
    got = {r.doc_id: r.asDict() for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want
