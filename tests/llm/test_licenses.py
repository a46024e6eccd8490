"""Licence texts with the licences they carry, worked out by hand."""

import textwrap

import duckdb
import pytest

from triplewright.llm import licenses

BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation.\n"

BSD3 = f"{BSD}3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
BSD_END = '\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE\nFOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL\nDAMAGES.'
BSD_NAMED = f"{BSD}3. Neither the name of Writers Inc. nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY.'
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
GPL2 = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version."
GPL3 = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
LGPL = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."
ISC = 'Copyright (c) 2020 A. Writer\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR\nANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES.'[30:]
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."


def wrapped(text, width):
    return textwrap.fill(" ".join(text.split()), width)


#: Text, licences, sentences that no licence took.
CASES = {
    "rights alone": ("All rights reserved.", "Proprietary", 0),
    "rights among prose": ("A short story.\nAll rights reserved.\nIt goes on here.", "Proprietary", 0),
    "rights and year": ("Copyright (c) 2020 A. Writer. All rights reserved.", "Proprietary", 0),
    "year alone": ("Copyright 2020 A Writer.", "", 1),
    "rights in a BSD heading": (f"Copyright (c) 2020, The Writers\nAll rights reserved.\n\n{BSD}", "BSD-2-Clause", 0),
    "BSD 2": (BSD + BSD_END, "BSD-2-Clause", 0),
    "BSD 3": (BSD3 + BSD_END, "BSD-3-Clause", 0),
    "BSD 3 with Inc.": (BSD_NAMED + BSD_END, "BSD-3-Clause", 0),
    "MIT in full": (MIT, "MIT", 0),
    "Apache in full": (APACHE, "Apache-2.0", 0),
    "GPL 2": (GPL2, "GPL-2.0-or-later", 0),
    "GPL 3": (GPL3, "GPL-3.0-or-later", 0),
    "GPL 3 in comments": ("# " + GPL3.replace("\n", "\n# "), "GPL-3.0-or-later", 0),
    **{f"GPL 2 at {w}": (wrapped(GPL2, w), "GPL-2.0-or-later", 0) for w in (60, 66, 72, 76, 80)},
    **{f"GPL 3 at {w}": (wrapped(GPL3, w), "GPL-3.0-or-later", 0) for w in (60, 66, 72, 76, 80)},
    "LGPL in full": (LGPL, "LGPL-2.1-or-later", 0),
    **{f"LGPL at {w}": (wrapped(LGPL, w), "LGPL-2.1-or-later", 0) for w in (60, 66, 72, 76, 80)},
    "MPL": (MPL, "MPL-2.0", 0),
    "MPL in comments": ("/* " + MPL.replace("\n", "\n * "), "MPL-2.0", 0),
    "MPL on one line": (" ".join(MPL.split()), "MPL-2.0", 0),
    **{f"AGPL at {w}": (wrapped(GPL3.replace("GNU General", "GNU Affero General"), w), "AGPL-3.0-or-later", 0) for w in (60, 66, 72, 76, 80)},
    "AGPL": (GPL3.replace("GNU General", "GNU Affero General"), "AGPL-3.0-or-later", 0),
    "ISC": (ISC, "ISC", 0),
    "MPL 1.1": ('The contents of this file are subject to the Mozilla Public License Version\n1.1 (the "License"); you may not use this file except in compliance with\nthe License.', "MPL-1.1", 0),
    **{f"EPL {v}": (f"This program and the accompanying materials are made available under the\nterms of the Eclipse Public License {n}, which is available at\nhttps://www.eclipse.org/legal/", v, 0) for v, n in (("EPL-2.0", "2.0"), ("EPL-1.0", "v1.0"), ("EPL-2.0", "version 2.0"))},
    "Unlicense": ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy it.", "Unlicense", 0),
    "Zlib": ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n", "Zlib", 0),
    "Perl": ("This library is free software; you can redistribute it and/or modify\nit under the same terms as Perl itself.", "Perl", 0),
    "Artistic 2": ("This program is free software; you can redistribute it and/or modify it\nunder the terms of the the Artistic License (2.0).", "Artistic-2.0", 0),
    "full GPL 3": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright holders.", "GPL-3.0", 0),
    "full GPL 2": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n", "GPL-2.0", 0),
    "full LGPL": ("                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n", "LGPL-2.1", 0),
    "full AGPL": ("                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n", "AGPL-3.0", 0),
    "full Apache": ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n", "Apache-2.0", 0),
    "tag in brackets": ("SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause)\n", "BSD-3-Clause,GPL-2.0", 0),
    "tag of three": ("// SPDX-License-Identifier: Apache-2.0 AND MIT OR ISC\nint x;", "MIT,Apache-2.0,ISC", 0),
    "tag with exception": ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\n", "GPL-2.0", 0),
    "tag of an unknown one": ("SPDX-License-Identifier: Foo-1.0\n", "", 1),
    "no tag": ("MIT OR Harvard\nMIT\n", "", 0),
    **{f"tag {t}": (f"SPDX-License-Identifier: {t}\n", want, 0) for t, want in (("ISC", "ISC"), ("Zlib", "Zlib"), ("Unlicense", "Unlicense"), ("AGPL-3.0-or-later", "AGPL-3.0-or-later"), ("AGPL-3.0-only", "AGPL-3.0"), ("MPL-1.1", "MPL-1.1"), ("EPL-2.0", "EPL-2.0"), ("EPL-1.0", "EPL-1.0"), ("Artistic-2.0", "Artistic-2.0"))},
    "headings": ("License\nGNU\nLibrary\nGeneral public\nMIT Press wrote it.\nMIT!!\n", "", 0),
    "German is no tag": ("Mit der Lizenz geht es weiter.", "", 0),
    "tag of two licences": ("SPDX-License-Identifier: MIT OR Apache-2.0", "MIT,Apache-2.0", 0),
    "tag before code": ("// SPDX-License-Identifier: MIT\n\n#include <stdio.h>", "MIT", 0),
    "tag in a comment": ("/* SPDX-License-Identifier: GPL-2.0 */", "GPL-2.0", 0),
    "tag MIT": ("SPDX-License-Identifier: MIT\n", "MIT", 0),
    "tag BSD-3-Clause": ("SPDX-License-Identifier: BSD-3-Clause\n", "BSD-3-Clause", 0),
    "tag BSD-2-Clause": ("SPDX-License-Identifier: BSD-2-Clause\n", "BSD-2-Clause", 0),
    "tag Apache-2.0": ("SPDX-License-Identifier: Apache-2.0\n", "Apache-2.0", 0),
    "tag GPL-3.0-or-later": ("SPDX-License-Identifier: GPL-3.0-or-later\n", "GPL-3.0-or-later", 0),
    "tag GPL-2.0-or-later": ("SPDX-License-Identifier: GPL-2.0-or-later\n", "GPL-2.0-or-later", 0),
    "tag GPL-2.0+": ("SPDX-License-Identifier: GPL-2.0+\n", "GPL-2.0-or-later", 0),
    "tag GPL-3.0-only": ("SPDX-License-Identifier: GPL-3.0-only\n", "GPL-3.0", 0),
    "tag GPL-2.0-only": ("SPDX-License-Identifier: GPL-2.0-only\n", "GPL-2.0", 0),
    "tag LGPL-2.1-or-later": ("SPDX-License-Identifier: LGPL-2.1-or-later\n", "LGPL-2.1-or-later", 0),
    "tag MPL-2.0": ("SPDX-License-Identifier: MPL-2.0\n", "MPL-2.0", 0),
    "tag CC-BY-NC-4.0": ("SPDX-License-Identifier: CC-BY-NC-4.0\n", "CC-BY-NC-4.0", 0),
    "tag CC-BY-SA-4.0": ("SPDX-License-Identifier: CC-BY-SA-4.0\n", "CC-BY-SA-4.0", 0),
    "tag CC-BY-4.0": ("SPDX-License-Identifier: CC-BY-4.0\n", "CC-BY-4.0", 0),
    "tag CC0-1.0": ("SPDX-License-Identifier: CC0-1.0\n", "CC0-1.0", 0),
    "MIT by name": ("This project is licensed under the MIT License.", "MIT", 0),
    "BSD by name": ("Released under the 3-clause BSD license.", "BSD-3-Clause", 0),
    "Apache by name": ("Licensed under the Apache License, Version 2.0.", "Apache-2.0", 0),
    "GPL 3 by name": ("Licensed under the GNU General Public License version 3.", "GPL-3.0", 0),
    "GPL 2 by name": ("Licensed under the GNU General Public License version 2.", "GPL-2.0", 0),
    "LGPL by name": ("Distributed under the GNU Lesser General Public License.", "LGPL", 0),
    "CC BY-NC": ("This work is licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", 0),
    "CC BY-SA": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0", 0),
    "CC BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0", 0),
    "CC0 over two lines": ("Dedicated to the public\ndomain.", "CC0-1.0", 0),
    "CC0 in comments": ("# Dedicated to the public\n# domain.", "CC0-1.0", 0),
    "CC0 with two spaces": ("Dedicated to the public  domain.", "CC0-1.0", 0),
    "CC0": ("This work is dedicated to the public domain.", "CC0-1.0", 0),
    "README line": ("This project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details.", "MIT", 0),
    "BSD style": ("// Copyright 2013 The Writers. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.", "BSD,Proprietary", 0),
    "GPL v3 only": ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, version 3.\n\nThis program is distributed in the hope that it will be useful, but\nWITHOUT ANY WARRANTY.", "GPL-3.0", 0),
    "kernel file": (" * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License version 2 as\n * published by the Free Software Foundation.\n */", "GPL-2.0", 0),
    "CC BY-SA 3.0 Unported": ("This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/3.0/.", "CC-BY-SA-3.0", 0),
    "CC BY-NC-ND 4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-NC-ND-4.0", 0),
    "CC by address": ("Text: https://creativecommons.org/licenses/by-nc/2.0/", "CC-BY-NC-2.0", 0),
    "Boost": ("// Distributed under the Boost Software License, Version 1.0.\n//    (See accompanying file LICENSE_1_0.txt or copy at\n//          https://www.boost.org/LICENSE_1_0.txt)", "BSL-1.0", 0),
    "WTFPL": ("This program is free software. It comes without any warranty, to\nthe extent permitted by applicable law. You can redistribute it\nand/or modify it under the terms of the Do What The Fuck You Want\nTo Public License, Version 2, as published by Sam Hocevar.", "WTFPL", 0),
    "CDDL": ("The contents of this file are subject to the terms of the\nCommon Development and Distribution License (the License).\nYou may not use this file except in compliance with the License.", "CDDL", 0),
    "CDDL with version": ("Licensed under the Common Development and Distribution License, Version 1.0 (the License)", "CDDL-1.0", 0),
    "EUPL": ("Licensed under the EUPL, Version 1.2 or \u2013 as soon they will be approved by\nthe European Commission - subsequent versions of the EUPL (the \"Licence\");", "EUPL-1.2", 0),
    "two names": ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "MIT,Apache-2.0", 0),
    "two unders": ("It is available under the MIT License and under the terms of the Mozilla Public License 2.0.", "MIT,MPL-2.0", 0),
    "GPL by short names": ("Released under the GPLv3. Parts are under GPL-2.0+ and LGPL v2.1 or later.", "GPL-2.0-or-later,GPL-3.0,LGPL-2.1-or-later", 0),
    "Unlicense by name": ("Licensed under the Unlicense", "Unlicense", 0),
    "opensource.org": ("License: https://opensource.org/licenses/BSD-3-Clause", "BSD-3-Clause", 0),
    "Apache twice": ("Licensed under the Apache License, Version 2.0.\n\nPortions are licensed under the Apache License, Version 2.0.", "Apache-2.0", 0),
    "under nothing known": ("The cat sleeps under the table and has permission to stay.", "", 0),
    "no licence at all": ("She asked for a driving licence under the new version of the law.", "", 0),
    **{f"SPDX {t}": (f"# SPDX-License-Identifier: {t}", t, 0) for t in ("BSL-1.0", "0BSD", "MIT-0", "BSD-4-Clause", "CDDL-1.1", "EUPL-1.1", "WTFPL", "CC-BY-NC-ND-4.0", "CC-BY-SA-3.0", "Artistic-1.0", "Python-2.0", "PostgreSQL", "NCSA", "OFL-1.1", "MS-PL", "LGPL-3.0-or-later", "LGPL-2.1", "GPL-1.0-or-later", "MPL-1.0", "Apache-1.1", "BUSL-1.1", "AFL-3.0", "curl", "X11")},
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(k, text) for k, (text, _, _) in enumerate(CASES.values())], "doc_id long, text string")
    rows = {r["doc_id"]: (r["licenses"], r["n_unmatched"]) for r in licenses.scan_licenses(df).collect()}
    return {name: rows[k] for k, name in enumerate(CASES)}


@pytest.mark.parametrize("name", CASES)
def test_known_texts(found, name):
    assert found[name] == CASES[name][1:]


def test_every_rule_and_opening_is_hit(spark):
    """No rule and no opening is dead: some text of the cases, or of those below, brings each of them out."""
    advert = "3. All advertising materials mentioning features or use of this software must display\n   the following acknowledgement.\n"
    boost = "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software."
    more = [
        BSD + advert + BSD_END, BSD.split("1. ")[0] + BSD_END, boost, "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions", "Mozilla Public License 2.0 Definitions follow.",
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n", GPL3 + "\n\nThis program is distributed in the hope that it will be useful.\n\nYou should have received a copy of the license.",
        LGPL + "\n\nThis library is distributed in the hope that it will be useful.", "Permission to use, copy, modify, and distribute this software for any purpose is granted.", "The software is provided as is.", "Placed in the public domain. It was released into the public domain.",
        "Released to the public domain.", "This file is released under public domain.", "The names of the authors are free.", MIT, "Mozilla Public License 2.0 Definitions",
    ]
    every = [f"SPDX-License-Identifier: {f}-{v}{k}" for f in licenses.GNU for v in licenses.GNU_VERSIONS for k in ("", "-or-later")]
    every += [f"SPDX-License-Identifier: {x}" for x in ("EUPL-1.1", "CDDL-1.1", "MPL-1.1")] + ["Licensed under the EUPL.", "You may not use this work except in compliance with the licence."]
    texts = [text for text, _, _ in CASES.values()] + more + every
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    seen = {x for r in rows for x in r["sentence_ids"].split(",")}
    assert [name for name in licenses.OPENINGS if name not in seen] == []
    named = {x for r in rows for x in r["licenses"].split(",")}
    assert [name for name, _ in licenses.RULES if name not in named] == []


def test_every_name_is_found(spark):
    """Each name in running text, with the words that were taken out of it, gives its licence."""
    listed = list(licenses.names().items())
    df = spark.createDataFrame([(k, f"It is licensed under the terms of the {name.replace('+', ' or any later version')} License. Thanks.") for k, (name, _) in enumerate(listed)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(df).collect()}
    assert [(name, licence, got[k]) for k, (name, licence) in enumerate(listed) if got[k] != licence] == []


def test_sql_gives_the_same(spark):
    """Over the cases: the two forms are made of one list of steps, but run by two engines."""
    rows = [(k, text) for k, (text, _, _) in enumerate(CASES.values())] + [(1000, None), (1001, ""), (1001, "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    out = con.execute(licenses.oracle())
    names = [c[0] for c in out.description]
    want = sorted(out.fetchall())
    df = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    assert df.columns == names and sorted(map(tuple, df.collect())) == want


def test_repeated_rows_long_texts_and_clashing_columns(spark):
    long = "word. " * 400_000 + MPL
    df = spark.createDataFrame([(1, MIT, 5, "x"), (1, MIT, 5, "x"), (None, MIT, 5, "x"), (2, long, 5, "x")], "doc_id long, text string, hit0 int, left string")
    rows = licenses.scan_licenses(df).collect()
    assert sorted(r["licenses"] for r in rows) == ["MIT", "MIT", "MIT", "MPL-2.0"] and len({r[1:] for r in rows if r["licenses"] == "MIT"}) == 1
