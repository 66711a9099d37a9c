"""Licence texts, standard headers and statements as template rows.

Fixed values: (licence, text).  The full texts lie in ``licences/``; those of
AGPL-3.0 and BSD-2-Clause are made out of GPL-3.0's and BSD-3-Clause's, from
which they differ by the name and by one clause.  Disclaimers alone name no
licence, so they are no templates.  A paragraph that several
licences share is a template of each: ``EVIDENCE`` tells them apart.
"""

from __future__ import annotations

import functools
import pkgutil

FULL = ("Apache-2.0", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1",
        "LGPL-3.0", "MPL-2.0", "Unlicense")

MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:"""
MIT_NOTICE = """The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
MIT_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose
with or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies."""
ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD
TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
file except in compliance with the License."""
APACHE_COPY = "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
APACHE_UNLESS = """Unless required by applicable law or agreed to in writing, software distributed
under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and
limitations under the License."""
ASF = """Licensed to the Apache Software Foundation (ASF) under one or more contributor license
agreements. See the NOTICE file distributed with this work for additional information regarding
copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0 (the
"License"); you may not use this file except in compliance with the License."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."""
MPL_COPY = """If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/."""
BSD_INTRO = """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met:"""
BSD_1 = """Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer."""
BSD_2 = """Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution."""
BSD_3 = """Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission."""
CC0 = """To the extent possible under law, the author(s) have dedicated all copyright and related
and neighboring rights to this software to the public domain worldwide. This software is distributed
without any warranty."""
CC0_COPY = """You should have received a copy of the CC0 Public Domain Dedication along with this
software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>."""

# (licence, versions it names, its name in words, the word for the program)
GNU = (("GPL-2.0", "2", "GNU General Public License", "program"),
       ("GPL-3.0", "3", "GNU General Public License", "program"),
       ("LGPL-2.1", "2.1", "GNU Lesser General Public License", "library"),
       ("LGPL-3.0", "3", "GNU Lesser General Public License", "library"),
       ("AGPL-3.0", "3", "GNU Affero General Public License", "program"))
CC = (("CC-BY", "Attribution", "by"), ("CC-BY-SA", "Attribution-ShareAlike", "by-sa"),
      ("CC-BY-NC", "Attribution-NonCommercial", "by-nc"),
      ("CC-BY-ND", "Attribution-NoDerivatives", "by-nd"),
      ("CC-BY-NC-SA", "Attribution-NonCommercial-ShareAlike", "by-nc-sa"),
      ("CC-BY-NC-ND", "Attribution-NonCommercial-NoDerivatives", "by-nc-nd"))


def _gnu(licence, version, name, program):
    free = f"""This {program} is free software; you can redistribute it and/or modify it under the
    terms of the {name} as published by the Free Software Foundation; """
    later = f"either version {version} of the License, or (at your option) any later version."
    hope = f"""This {program} is distributed in the hope that it will be useful, but WITHOUT ANY
    WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
    PURPOSE. See the {name} for more details."""
    copy = f"""You should have received a copy of the {name} along with this {program}. If not, see
    <https://www.gnu.org/licenses/>."""
    short = licence.split("-")[0]
    return [(licence, t) for t in (
        free + later, free + f"version {version} of the License.", hope, copy,
        " ".join([free + later, hope, copy]),
        f"This work is licensed under the {name}, version {version}",
        f"{name} Version {version}", f"Licensed under the {short} version {version}",
        f"Released under the {short}v{version}")]


def _cc(stem, name, path):
    says = f"This work is licensed under a Creative Commons {name} 4.0 International License."
    seen = f"""To view a copy of this license, visit http://creativecommons.org/licenses/{path}/4.0/
    or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."""
    return [(f"{stem}-4.0", t) for t in (
        says, f"{says} {seen}", f"Creative Commons {name} 4.0 International Public License",
        f"Licensed under CC {path.upper()} 4.0")]


def _bsd(licence, clauses, number):
    listed = " ".join([BSD_INTRO, *(f"{k}. {c}" for k, c in enumerate(clauses, 1))])
    return [(licence, t) for t in (
        listed, BSD_INTRO, BSD_1, BSD_2, f"Licensed under the BSD {number}-Clause License",
        f"BSD {number}-Clause License")]


HEADERS = tuple(
    [("Apache-2.0", t) for t in (
        APACHE, f"{APACHE} {APACHE_COPY}", f"{APACHE} {APACHE_COPY} {APACHE_UNLESS}", APACHE_UNLESS,
        ASF, f"{ASF} {APACHE_COPY} {APACHE_UNLESS}", "Apache License Version 2.0, January 2004",
        "This file is licensed under the Apache License, Version 2.0")]
    + [("MIT", t) for t in (
        MIT_GRANT, f"{MIT_GRANT} {MIT_NOTICE} {MIT_AS_IS}", "The MIT License (MIT)",
        "This project is licensed under the terms of the MIT license",
        "Use of this source code is governed by an MIT-style license that can be found in the "
        "LICENSE file")]
    + [("ISC", t) for t in (ISC_GRANT, f"{ISC_GRANT} {ISC_AS_IS}", "ISC License",
                            "Licensed under the ISC License")]
    + [("MPL-2.0", t) for t in (MPL, MPL_COPY, f"{MPL} {MPL_COPY}",
                                "Mozilla Public License Version 2.0")]
    + _bsd("BSD-2-Clause", (BSD_1, BSD_2), 2) + _bsd("BSD-3-Clause", (BSD_1, BSD_2, BSD_3), 3)
    + [("BSD-3-Clause", BSD_3),
       ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be "
                        "found in the LICENSE file.")]
    + [("CC0-1.0", t) for t in (CC0, CC0_COPY, f"{CC0} {CC0_COPY}",
                                "Creative Commons CC0 1.0 Universal Public Domain Dedication")]
    + [("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.")]
    + [("Unlicense", "This is free and unencumbered software released into the public domain.")]
    + [row for x in CC for row in _cc(*x)] + [row for x in GNU for row in _gnu(*x)])

# Which of several licences with the same paragraph is meant, as a rule for the
# lower-cased text around it.
_V = r"(?:version|gpl|license|licence|v)[ ,.-]*v?"
_END = r"(?![0-9]|[.][0-9])"
EVIDENCE = (("AGPL-3.0", _V + r"3(?:[.]0)?" + _END), ("BSD-3-Clause", "neither the name"),
            ("GPL-2.0", _V + r"2(?:[.]0)?" + _END), ("GPL-3.0", _V + r"3(?:[.]0)?" + _END),
            ("LGPL-2.1", _V + r"2[.]1" + _END), ("LGPL-3.0", _V + r"3(?:[.]0)?" + _END))
# Parts of words of which every text and header above has at least one.
LICENCE_WORDS = ("licen", "copyright", "permission", "warrant", "redistribut", "mozilla", "gpl",
                 "unencumbered", "dedication")


@functools.cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """(licence, whole text) of each licence."""
    text = {n: pkgutil.get_data(__package__, f"licences/{n}.txt").decode() for n in FULL}
    body = text["BSD-3-Clause"]
    lo, hi = body.index("3. Neither"), body.index("THIS SOFTWARE IS")
    text["BSD-2-Clause"] = body[:lo] + "\n" + body[hi:]
    gpl, at = text["GPL-3.0"], text["GPL-3.0"].index("  13. Use with")
    for a, b in (("GNU General Public License", "GNU Affero General Public License"),
                 ("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE")):
        gpl = gpl[:at].replace(a, b) + gpl[at:].replace(a, b)
        at = gpl.index("  13. Use with")
    text["AGPL-3.0"] = gpl
    text["MIT"] = "\n\n".join(["MIT License", MIT_GRANT, MIT_NOTICE, MIT_AS_IS])
    text["ISC"] = "\n\n".join(["ISC License", ISC_GRANT, ISC_AS_IS])
    return tuple(sorted(text.items()))


def texts() -> tuple[tuple[str, str], ...]:
    """All templates: headers, then full texts."""
    return HEADERS + full_texts()
