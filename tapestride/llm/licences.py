"""Licence scan by sentence rules.

Texts are cut into sentences; a sentence whose normalised words are those of a known licence sentence becomes its
identifier; a text's sequence of identifiers is matched against ordered rules, the longest rule first. Identifiers
of one match may have up to `GAP` unknown sentences between them.

Sentences are of three kinds: fixed ones of whole licence texts, some with a part that varies (`*`: one to eight
words, such as a holder's name); notices, a head, a licence's name in any of its spellings and perhaps a tail; and
`SPDX-License-Identifier` lines, of which each known identifier of the expression counts.

Cases: a null or empty text has no match and no row; a sentence may be wrapped over lines, or stand on a line
without a full stop; a repeated notice gives a row each time; repeated rows and null ids are scanned row by row;
very long texts are scanned in whole; only the id and the text column are read. A reservation of all rights is no
licence: its rows have the kind "reservation".
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import field_ddl, table, text_of

GAP = 2

# Sentences of public licences, normalised (lower-case words and numbers).
SENTENCES = {
    "apache.short": "licensed under the apache license version 2 0",
    "apache.licensed": "licensed under the apache license version 2 0 the license",
    "apache.comply": "you may not use this file except in compliance with the license",
    "apache.obtain": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache.asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache.see": "see the license for the specific language governing permissions and limitations under the license",
    "mit.short": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3.short": "this work is licensed under the gnu general public license version 3",
    "gpl.redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2.redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl.see": "see the gnu general public license for more details",
    "bsd.redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl.subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl.obtain": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "ccbync.short": "licensed under cc by nc 4 0",
    "ccbysa.short": "licensed under cc by sa 4 0",
    "ccby.short": "licensed under cc by 4 0",
    "unlicense.free": "this is free and unencumbered software released into the public domain",
    "unlicense.anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "mit.event": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit0.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "bsd.asis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd.event": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd.endorse.named": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "isc.asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc.zero": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib.asis": "this software is provided as is without any express or implied warranty",
    "zlib.grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib.origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "boost.grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "boost.short": "distributed under the boost software license version 1 0",
    "wtfpl.title": "do what the fuck you want to public license",
    "gpl3.preamble": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "gpl3.freedom": "the licenses for most software and other practical works are designed to take away your freedom to share and change the works",
    "gpl2.freedom": "the licenses for most software are designed to take away your freedom to share and change it",
    "agpl3.preamble": "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    "lgpl3.incorporates": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "lgpl21.successor": "this is the first released version of the lesser gpl",
    "lgpl21.redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3.redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3.redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gnu.verbatim": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "apache.grant": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "mpl.incompatible": "this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0",
    "epl.subject": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "cc0.waive": "to the extent possible under law * has waived all copyright and related or neighboring rights to this work",
    "reserved": "all rights reserved",
}
# Licence and the ordered sentences that state it.
RULES = (
    ("Apache-2.0", ("apache.licensed", "apache.comply", "apache.obtain", "apache.asis", "apache.see")),
    ("Apache-2.0", ("apache.licensed", "apache.comply", "apache.obtain")),
    ("Apache-2.0", ("apache.licensed", "apache.comply")),
    ("Apache-2.0", ("apache.short",)),
    ("MIT", ("mit.grant", "mit.notice", "mit.asis")),
    ("MIT", ("mit.grant", "mit.notice")),
    ("MIT", ("mit.short",)),
    ("MIT", ("mit.licensed",)),
    ("GPL-3.0-or-later", ("gpl.redistribute", "gpl.hope", "gpl.see")),
    ("GPL-3.0-or-later", ("gpl.redistribute",)),
    ("GPL-2.0-or-later", ("gpl2.redistribute", "gpl.hope", "gpl.see")),
    ("GPL-2.0-or-later", ("gpl2.redistribute",)),
    ("GPL-3.0-only", ("gpl3.short",)),
    ("BSD-3-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("BSD-2-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary")),
    ("ISC", ("isc.grant",)),
    ("MPL-2.0", ("mpl.subject", "mpl.obtain")),
    ("MPL-2.0", ("mpl.subject",)),
    ("CC-BY-NC-4.0", ("ccbync.short",)),
    ("CC-BY-SA-4.0", ("ccbysa.short",)),
    ("CC-BY-4.0", ("ccby.short",)),
    ("Unlicense", ("unlicense.free",)),
    ("LicenseRef-AllRightsReserved", ("reserved",)),
    ("MIT", ("mit.grant", "mit.notice", "mit.asis", "mit.event")),
    ("MIT-0", ("mit0.grant", "mit.asis", "mit.event")),
    ("MIT-0", ("mit0.grant", "mit.asis")),
    ("BSD-4-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.advert", "bsd.endorse.named", "bsd.asis", "bsd.event")),
    ("BSD-4-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.advert")),
    ("BSD-3-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.endorse", "bsd.asis", "bsd.event")),
    ("BSD-3-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.endorse.named", "bsd.asis", "bsd.event")),
    ("BSD-3-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.endorse.named")),
    ("BSD-2-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.asis", "bsd.event")),
    ("ISC", ("isc.grant", "isc.asis")),
    ("0BSD", ("isc.zero", "isc.asis")),
    ("Zlib", ("zlib.asis", "zlib.grant", "zlib.origin")),
    ("Zlib", ("zlib.grant", "zlib.origin")),
    ("BSL-1.0", ("boost.grant",)),
    ("BSL-1.0", ("boost.short",)),
    ("WTFPL", ("wtfpl.title",)),
    ("Unlicense", ("unlicense.free", "unlicense.anyone")),
    ("GPL-3.0-only", ("gnu.verbatim", "gpl3.preamble", "gpl3.freedom")),
    ("GPL-3.0-only", ("gpl3.preamble", "gpl3.freedom")),
    ("GPL-2.0-only", ("gnu.verbatim", "gpl2.freedom")),
    ("AGPL-3.0-only", ("gnu.verbatim", "agpl3.preamble")),
    ("AGPL-3.0-only", ("agpl3.preamble",)),
    ("LGPL-3.0-only", ("gnu.verbatim", "lgpl3.incorporates")),
    ("LGPL-3.0-only", ("lgpl3.incorporates",)),
    ("LGPL-2.1-only", ("gnu.verbatim", "lgpl21.successor")),
    ("LGPL-2.1-or-later", ("lgpl21.redistribute",)),
    ("LGPL-3.0-or-later", ("lgpl3.redistribute",)),
    ("AGPL-3.0-or-later", ("agpl3.redistribute", "gpl.hope")),
    ("AGPL-3.0-or-later", ("agpl3.redistribute",)),
    ("Apache-2.0", ("apache.grant",)),
    ("MPL-2.0-no-copyleft-exception", ("mpl.incompatible",)),
    ("EPL-2.0", ("epl.subject",)),
    ("CC0-1.0", ("cc0.waive",)),
)

# Names of licences, normalised, without an article before and "license" after.
NAMES = {
    "MIT": ("mit", "mit x11", "expat", "mit mit"), "Apache-2.0": ("apache 2 0", "apache 2", "apache software", "apache v2", "apache v2 0", "apache version 2 0", "apache license version 2 0", "apache license v2 0", "apache license 2 0", "apache 2 0 apache 2 0", "asl 2 0"),
    "BSD-2-Clause": ("bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd", "bsd 2 clause simplified"), "BSD-3-Clause": ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd", "bsd 3 clause new or revised"), "BSD-4-Clause": ("bsd 4 clause", "4 clause bsd", "original bsd"),
    "ISC": ("isc",), "Zlib": ("zlib", "zlib libpng"), "BSL-1.0": ("boost software", "boost software license 1 0", "boost software license version 1 0", "bsl 1 0"), "Unlicense": ("unlicense", "the unlicense"), "WTFPL": ("wtfpl", "do what the fuck you want to public"),
    "MPL-2.0": ("mozilla public license 2 0", "mozilla public license version 2 0", "mozilla public license v2 0", "mozilla public license v 2 0", "mpl 2 0", "mpl v2", "mpl2", "mplv2"), "EPL-2.0": ("eclipse public license 2 0", "eclipse public license v2 0", "eclipse public license version 2 0", "epl 2 0"), "EPL-1.0": ("eclipse public license 1 0", "eclipse public license v1 0", "epl 1 0"),
    "CDDL-1.0": ("common development and distribution license 1 0", "cddl 1 0", "cddl"), "Artistic-2.0": ("artistic license 2 0", "artistic 2 0"), "0BSD": ("zero clause bsd", "bsd zero clause", "0bsd"), "PSF-2.0": ("python software foundation", "psf", "psf license version 2"), "MIT-0": ("mit no attribution", "mit 0"), "CC0-1.0": ("cc0", "cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal", "creative commons cc0 1 0 universal"),
}
#: GNU families and the spellings of a version; Creative Commons elements and versions: their names follow from these.
GNU = {"GPL": ("gnu general public license", "general public license", "gnu gpl", "gpl"), "LGPL": ("gnu lesser general public license", "lesser general public license", "gnu lgpl", "lgpl"), "AGPL": ("gnu affero general public license", "affero general public license", "gnu agpl", "agpl")}
GNU_VERSIONS = {"GPL": ("2.0", "3.0"), "LGPL": ("2.1", "3.0"), "AGPL": ("3.0",)}
LATER = ("or later", "or any later version", "or later version", "or at your option any later version", "and later", "plus")
CC = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}
CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
#: Heads and tails of notices.
THINGS = ("project", "software", "work", "code", "source code", "file", "program", "library", "package", "repository", "document", "documentation", "content", "module", "data", "dataset", "material")
VERBS = ("licensed", "released", "distributed", "available", "published", "provided", "made available", "dual licensed", "copyrighted", "open sourced")
TAILS = ("see the license file", "see the license file for details", "see the license file for more details", "see the license file for more information", "see license for details", "see license for more details", "see license for more information", "see license md for details", "see license txt for details", "see license md file for details",
         "see the license md file for details", "see the license md license md file for details", "see the license license file for details", "see the file license", "see license", "see the accompanying license file", "see copying", "see the copying file", "see copying for details")


def licence_names() -> dict[str, str]:
    """SPDX identifier of each normalised name, without an article before it and "license" after it."""
    out = {n: spdx for spdx, names in NAMES.items() for n in names}
    for family, names in GNU.items():
        for version in GNU_VERSIONS[family]:
            whole, dotted = version.split(".")[0], version.replace(".", " ")
            spelled = {dotted, f"v{dotted}", f"v {dotted}", f"version {dotted}"} | ({whole, f"v{whole}", f"v {whole}", f"version {whole}"} if version.endswith(".0") else set())
            for name in names:
                for v in spelled:
                    for joined in {f"{name} {v}"} | ({f"{name}{v}"} if name.endswith("gpl") else set()):
                        out[joined] = out[f"{joined} only"] = f"{family}-{version}-only"
                        out |= {f"{joined} {later}": f"{family}-{version}-or-later" for later in LATER}
    for elements, long in CC.items():
        for version in CC_VERSIONS:
            v, spdx = version.replace(".", " "), f"CC-{elements}-{version}"
            short = elements.lower().replace("-", " ")
            spaced = long.replace("noncommercial", "non commercial").replace("sharealike", "share alike").replace("noderivatives", "no derivatives")
            for name in (f"cc {short}", f"creative commons {long}", f"creative commons {spaced}", f"creative commons {short}"):
                out |= {f"{name} {v}": spdx, f"{name} v{v}": spdx, f"{name} {v} international": spdx, f"{name} {v} unported": spdx, f"{name} {v} generic": spdx, f"{name} license {v}": spdx, f"{name} {v} international public": spdx}
    return out


def spdx_ids() -> dict[str, str]:
    """Known SPDX identifiers by their lower-case form; a GNU one without an ending is the version only, a plus the later ones."""
    known = set(licence_names().values()) | {licence for licence, _ in RULES if not licence.startswith("LicenseRef")}
    out = {x.lower(): x for x in known}
    for x in known:
        if x.endswith("-only"):
            out[x[:-5].lower()], out[x[:-5].lower() + "+"] = x, x[:-5] + "-or-later"
    return out



#: A fragment ends at a line end, or at a stop before white space; a sentence is one fragment or several lines.
FRAGMENT = re.compile(r"[^.!?;:\n]+(?:[.!?;:]+(?=[^\s.!?;:])[^.!?;:\n]+)*")
WORDS = re.compile(r"[a-z0-9]+")


NOTICE = re.compile(
    r"(?:(?:(?:this|the|our|all|these) )?(?:" + "|".join(THINGS) + r")s? )?(?:(?:is|are) )?(?:" + "|".join(VERBS) + r") (?:to you )?under (?:the terms of |the conditions of )?(.+?)(?: (?:" + "|".join(sorted(TAILS, key=len, reverse=True)) + r"))?"
)
NOTICE_FIRST = frozenset(v.split()[0] for v in VERBS) | frozenset(f"{t.split()[0]}{s}" for t in THINGS for s in ("", "s")) | frozenset("this the our all these is are license licence".split())
#: Fragments that one notice may be wrapped over, and words of a part that varies.
WRAPPED, VARIES = 4, 8
SPDX_TAG = ("spdx", "license", "identifier")
SPDX_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")


class Scanner:
    def __init__(self, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES, gap: int = GAP):
        fixed = {name: s for name, s in sentences.items() if "*" not in s}
        self.by_text = {tuple(s.split()): name for name, s in fixed.items()}
        if len(self.by_text) < len(fixed):
            raise ValueError("two sentence identifiers have one text")
        self.first = {words[0] for words in self.by_text}
        self.starts: set[tuple[str, ...]] = {words[:k] for words in self.by_text for k in range(1, len(words) + 1)}
        self.varied = [(s.split()[0], re.compile(s.replace("*", rf"\w+(?: \w+){{0,{VARIES - 1}}}")), name) for name, s in sentences.items() if "*" in s]
        self.varied_first = {w for w, _, _ in self.varied}
        self.names, self.spdx = licence_names(), spdx_ids()
        self.rules, self.gap = sorted(rules, key=lambda r: -len(r[1])), gap
        self.single = {f"{kind}:{x}": x for kind in ("notice", "title", "spdx") for x in set(self.spdx.values())}

    def named(self, name: str) -> str | None:
        """The licence of a name with or without an article and "license"."""
        name = re.sub(r"^(?:the|a|an) ", "", name)
        return self.names.get(name) or self.names.get(re.sub(r" licen[sc]es?$", "", name)) or self.names.get(re.sub(r" licen[sc]e(?= )", "", name, count=1))

    def slot(self, words: tuple[str, ...]) -> str | None:
        """Identifier of a notice, or of a name that stands as a sentence of its own."""
        text = " ".join(words)
        if (m := NOTICE.fullmatch(text)) and (x := self.named(m[1])):
            return f"notice:{x}"
        if 1 < len(words) <= 9 and words[-1] in ("license", "licence", "mit") and (x := self.named(text)):
            return f"title:{x}"
        if words[0] in ("license", "licence") and 1 < len(words) <= 9 and (x := self.named(" ".join(words[1:]))):
            return f"title:{x}"
        return None

    def sentences(self, text: str) -> list[tuple[str | None, int, int]]:
        """(identifier or None, start, end) of each sentence."""
        found = [(m.start(), m.end()) for m in FRAGMENT.finditer(text)]
        low, out, k = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text), [], 0
        cache: dict[int, tuple[str, ...]] = {}

        def words_of(j: int) -> tuple[str, ...]:
            if j not in cache:
                cache[j] = tuple(WORDS.findall(low, *found[j]))
            return cache[j]

        while k < len(found):
            start, end = found[k]
            m = WORDS.search(low, start, end)
            best = None
            if m and m[0] in self.first:
                words: tuple[str, ...] = ()
                for j in range(k, len(found)):
                    words += words_of(j)
                    if words not in self.starts:
                        break
                    if words in self.by_text:
                        best = (self.by_text[words], j)
            if m and not best and m[0] in self.varied_first:
                words = ()
                for j in range(k, min(k + 4 * WRAPPED, len(found))):
                    words += words_of(j)
                    best = next(((name, j) for _, pattern, name in self.varied if pattern.fullmatch(" ".join(words))), best)
            if m and not best and m[0] == "spdx" and words_of(k) == SPDX_TAG:
                line = text.find("\n", end)
                line = len(text) if line < 0 else line
                ids = [self.spdx[x[0].lower()] for x in SPDX_ID.finditer(text, end, line) if x[0].lower() in self.spdx]
                if ids:
                    out += [(f"spdx:{x}", m.start(), line) for x in dict.fromkeys(ids)]
                    while k < len(found) and found[k][0] < line:
                        k += 1
                    continue
            if m and not best and (m[0] in NOTICE_FIRST or len(words_of(k)) <= 9 and words_of(k)[-1] in ("license", "licence", "mit")):
                words = ()
                for j in range(k, min(k + WRAPPED, len(found))):
                    words += words_of(j)
                    if name := self.slot(words) if words else None:
                        best = (name, j)
            if best:
                out.append((best[0], m.start(), found[best[1]][1]))
                k = best[1] + 1
            else:
                out.append((None, start, end))
                k += 1
        return out

    def scan(self, text: str) -> list[tuple[str, list[str], int, int]]:
        """(licence, identifiers, start, end) of each match; no identifier belongs to two."""
        ids = [(k, *x) for k, x in enumerate(self.sentences(text)) if x[0]]
        out, at = [], 0
        while at < len(ids):
            for licence, rule in self.rules:
                part = ids[at : at + len(rule)]
                if tuple(x[1] for x in part) == rule and all(b[0] - a[0] <= self.gap + 1 for a, b in zip(part, part[1:])):
                    out.append((licence, list(rule), part[0][2], part[-1][3]))
                    at += len(rule)
                    break
            else:
                if ids[at][1] in self.single:
                    out.append((self.single[ids[at][1]], [ids[at][1]], ids[at][2], ids[at][3]))
                at += 1
        return out


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """One row per match: id, license, kind, sentence_ids, first_char, end_char (code points)."""
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sentences, rules)
        for batch in batches:
            found = [(k, *x) for k, t in enumerate(batch.column(1)) for x in scanner.scan(t.as_py())]
            cols = [batch.column(0).take(pa.array([x[0] for x in found], pa.int64())), pa.array([x[1] for x in found], pa.string()), pa.array(["reservation" if x[1] == "LicenseRef-AllRightsReserved" else "licence" for x in found], pa.string()), pa.array([x[2] for x in found], pa.list_(pa.string())), pa.array([x[3] for x in found], pa.int64()), pa.array([x[4] for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "license", "kind", "sentence_ids", "first_char", "end_char"])

    return rows.mapInArrow(run, f"{field_ddl(rows, 'id', id_col)}, license string, kind string, sentence_ids array<string>, first_char bigint, end_char bigint")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))
