"""Licence scans on typed texts, and against the DuckDB text."""

import duckdb
import pandas as pd

from gleaner.llm import licences

MIT = """MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files. The above copyright notice and this permission notice shall be
included in all copies. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD = """Redistribution and use in source and binary forms are permitted. Redistributions of source code must retain this.
Redistributions in binary form must reproduce this. {}This software is provided by the copyright holders and contributors "as is"."""
CASES = [
    ("prose.\nLicensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"),
    ("Released under the MIT License.", "MIT"),
    (MIT, "MIT"),
    (BSD.format(""), "BSD-2-Clause"),
    (BSD.format("Neither the name of the Foo may be used to endorse products. "), "BSD-3-Clause"),
    ("GNU General Public License version 2; at your option any later version of the license.", "GPL-2.0-or-later"),
    ("Under the MIT license. word " * 3 + MIT + " Licensed under CC BY-SA 4.0. Apache License 2.0!", "Apache-2.0,CC-BY-SA,MIT"),
    ("No licence here. A public affair.", ""),
    ("x " * 100000 + ". SPDX-License-Identifier: MIT", "MIT"),
    ("// SPDX-License-Identifier: Apache-2.0\n#include <x.h>\n", "Apache-2.0"),
    ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0-or-later"),
    ("# SPDX-License-Identifier: GPL-3.0-only\n", "GPL-3.0"),
    ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ("SPDX-License-Identifier: Apache-2.0 OR MIT", "Apache-2.0,MIT"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT"),
    ("Dual licensed under the MIT License or the Apache License, Version 2.0.", "Apache-2.0,MIT"),
    ("Licensed under either of the Apache License, Version 2.0 or the MIT license at your option.", "Apache-2.0,MIT"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by\n"
     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GPL-3.0-or-later"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License\nas published by "
     "the Free Software Foundation; either version 2\nof the License, or (at your option) any later version.", "GPL-2.0-or-later"),
    ("This library is free software; it is under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
     "either version 2.1 of the License, or (at your option) any later version.", "LGPL"),
    ("Under version 2 of the GNU General Public License. Plugins: GPLv3.", "GPL-2.0,GPL-3.0"),
    ("Redistribution and use in source and binary forms are permitted provided that the following conditions are met: * Redistributions of source code "
     "must retain the notice; * Redistributions in binary form must reproduce it.", "BSD-2-Clause"),
    ("x " * 100000 + "\n\nSPDX-License-Identifier MIT", "MIT"),
    ("", ""),
    (None, ""),
]


def rows(spark):
    return spark.createDataFrame([(i, t, "l", 0) for i, (t, _) in enumerate(CASES)] + [(None, CASES[0][0], "l", 0)] + [(0, CASES[0][0], "l", 0)] * 2,
                                 "doc_id long, text string, licences string, ids int")


def test_typed_cases(spark):
    got = [tuple(r) for r in licences.scan(rows(spark)).collect()]
    assert len(got) == len(CASES) + 3
    for i, (_, want) in enumerate(CASES):
        assert {r[3] for r in got if r[0] == i} == {want}, i
    assert next(r for r in got if r[0] == 6)[1:3] == (5, "bsd_redist,bsd_source,bsd_binary,bsd_endorse,bsd_disclaim")
    assert licences.scan(rows(spark).limit(0)).collect() == []


def test_same_as_sql(spark):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([tuple(r)[:2] for r in rows(spark).collect()], columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    want = sorted(con.execute(licences.oracle()).fetchall(), key=str)
    assert sorted((tuple(r) for r in licences.scan(rows(spark)).collect()), key=str) == want
