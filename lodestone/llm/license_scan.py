"""Licence scan by sentence rules.

A text is cut into sentences, each is normalised to its words and mapped to the
identifier of a known licence sentence, and the sequence of identifiers is
matched against ordered rules, longer ones first, each of which names a licence.

Comment marks and list numbers at the start of lines are dropped. A sentence
ends at a blank line and at . ! ? before a capital, a digit or a quote, unless
the word before is an abbreviation ("v. 2.0", "Foo Inc. Bar"). The end of a
line, : and ; may end a sentence or not, as licences are wrapped and titles are
not punctuated: runs of the pieces between them are tried, the longest first.

A known sentence is a template over normalised words: (a|b) are alternatives, a
word in square brackets may be missing, and <name> stands for one to twelve
words, such as the holder in "neither the name of <name> nor ...". Notices ("this file is
released under the GNU GPL, version 3 or later") are one template over a table
of licence names; they, unlike other templates, may stand within a sentence, but
not after "not".
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GNU = "(this program|this library|this file|this software|it|<name>) is free software you can redistribute it and or modify it under the terms of the gnu {family}general public license"
_FSF = " as published by the free software foundation"
# Known licence sentences by identifier, as templates over normalised words.
SENTENCES = {
    "apache-comply": ("you may not use (this file|these files|this software|this work|<name>) except in compliance with the license",),
    "apache-copy": ("you may obtain a copy of the license at [<name>]",),
    "apache-asis": ("unless required by applicable law or agreed to in writing (software|<name>) distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "apache-see": ("see the license for the specific language governing permissions and limitations under the license",),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit-notice": ("the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software",),
    "mit-asis": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "mit-liability": ("in no event shall the (authors|<name>) [or copyright holders] be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "bsd-redist": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-endorse": (
        "neither the name of <name> nor the names of [its|his|her|their|the] [<name>] contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the (names|name) of <name> may be used to endorse or promote products derived from this software without specific prior written permission",
        "the (name|names) of <name> may not be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "bsd-asis": ("this software is provided by <name> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
    "gnu-warranty": ("(this program|this library|this file|this software|it|<name>) is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "gnu-see": ("see the gnu [lesser|library|affero] general public license for more details",),
    "gnu-copy": ("you should have received a copy of the gnu [lesser|library|affero] general public license along with (this program|this library|this file|<name>) [if not <name>]",),
    "mpl-form": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "mpl-copy": ("if a copy of the mpl was not distributed with this file you can obtain one at <name>",),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "isc-asis": ("the software is provided as is and <name> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "zlib-asis": ("this software is provided as is without any express or implied warranty",),
    "zlib-liability": ("in no event will the authors be held liable for any damages arising from the use of this software",),
    "zlib-grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "unlicense-free": ("this is free and unencumbered software released into the public domain",),
    "unlicense-anyone": ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",),
    "bsl-grant": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software <name> all subject to the following",),
    "epl-1": ("this program and the accompanying materials are made available under the terms of the eclipse public license v 1 0 [which <name>]",),
    "epl-2": ("this program and the accompanying materials are made available under the terms of the eclipse public license [v|version] 2 0 [which <name>]",),
    "cc0-waive": ("to the extent possible under law (the author|<name>) (has|have) waived all copyright and related or neighboring rights to this work",),
    "reserved": ("all rights reserved", "copyright <name> all rights reserved"),
}
_FAMILIES = {"gpl": ("", ("1 0", "2 0", "3 0")), "lgpl": ("(lesser|library) ", ("2 0", "2 1", "3 0")), "agpl": ("affero ", ("1 0", "3 0"))}
for _name, (_family, _versions) in _FAMILIES.items():
    for _version in _versions:
        _v = _version.removesuffix(" 0") + (" [0]" if _version.endswith(" 0") else "")
        SENTENCES[f"{_name}-{_version.replace(' ', '.')}-later"] = (_GNU.format(family=_family) + _FSF + f" [either] version {_v} of the license or [at your option] any later version",)
        SENTENCES[f"{_name}-{_version.replace(' ', '.')}-only"] = (
            _GNU.format(family=_family) + _FSF + f" version {_v} of the license [only]", _GNU.format(family=_family) + f" version {_v}" + _FSF, _GNU.format(family=_family) + f" version {_v} only" + _FSF,
        )
# Licence names in notices, as patterns over normalised words, and what they name; {v} and {later} are filled in.
NOTICES = (
    (r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?", "Apache-2.0"), (r"mit(?: x11| expat)?", "MIT"), (r"expat", "MIT"), (r"isc", "ISC"), (r"zlib(?: libpng)?", "Zlib"), (r"unlicense", "Unlicense"),
    (r"(?:new|modified|revised|3 clause|three clause) bsd|bsd (?:3|three) clause", "BSD-3-Clause"), (r"(?:simplified|2 clause|two clause) bsd|bsd (?:2|two) clause|freebsd", "BSD-2-Clause"), (r"bsd(?: style)?", "BSD"),
    (r"(?:gnu )?(?:(?:lesser|library) general public license|lgpl)(?: version)? ?v?(?P<v>2 1|3|2)(?: 0)?", "LGPL-{v}{later}"), (r"(?:gnu )?(?:affero general public license|agpl)(?: version)? ?v?(?P<v>[13])(?: 0)?", "AGPL-{v}{later}"),
    (r"(?:gnu )?(?:general public license|gpl)(?: version)? ?v?(?P<v>[123])(?: 0)?", "GPL-{v}{later}"),
    (r"(?:gnu )?(?:lesser|library) general public license|(?:gnu )?lgpl", "LGPL"), (r"(?:gnu )?affero general public license|(?:gnu )?agpl", "AGPL"), (r"(?:gnu )?general public license|(?:gnu )?gpl", "GPL"),
    (r"(?:mozilla public license|mpl)(?: version)? ?v?(?P<v>1 0|1 1|2 0|2)", "MPL-{v}"), (r"(?:eclipse public license|epl)(?: version)? ?v?(?P<v>1|2)(?: 0)?", "EPL-{v}"), (r"boost software license(?: version)? ?v?(?: ?1 0)?", "BSL-1.0"),
    (r"(?:cc0|cc zero|creative commons zero)(?: v)?(?: ?1 0)?(?: universal)?", "CC0-1.0"),
    (r"(?:cc|creative commons) (?:by|attribution)(?P<kind>(?: (?:nc|nd|sa|non ?commercial|no ?deriv(?:ative)?s|share ?alike))*)(?: license)?(?: version| v)? ?(?P<v>[1-4])(?: [05])?", "CC-BY{kind}-{v}"),
    (r"(?:cc|creative commons) (?:by|attribution)(?P<kind>(?: (?:nc|nd|sa|non ?commercial|no ?deriv(?:ative)?s|share ?alike))*)", "CC-BY{kind}"),
)
_LATER = r"(?P<later>\+| or (?:at your option )?(?:any )?(?:later|newer|higher|greater)(?: versions?)?)?"
_KINDS = (("noncommercial", "NC"), ("non commercial", "NC"), ("nc", "NC"), ("sharealike", "SA"), ("share alike", "SA"), ("sa", "SA"), ("noderivatives", "ND"), ("no derivatives", "ND"), ("noderivs", "ND"), ("nd", "ND"))
#: Ordered rules: sequences of identifiers and the licence they make; each also holds without its last identifiers, down to the number given. Of the rules that fit at a place the longest holds, then the first.
RULES = (
    (("notice:Apache-2.0", "apache-comply", "apache-copy", "apache-asis", "apache-see"), 1, "Apache-2.0"), (("apache-comply", "apache-copy", "apache-asis", "apache-see"), 3, "Apache-2.0"),
    (("mit-grant", "mit-notice", "mit-asis", "mit-liability"), 1, "MIT"), (("isc-grant", "isc-asis"), 1, "ISC"), (("bsl-grant",), 1, "BSL-1.0"), (("unlicense-free", "unlicense-anyone"), 1, "Unlicense"),
    (("bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis"), 4, "BSD-3-Clause"), (("bsd-redist", "bsd-source", "bsd-binary", "bsd-asis"), 3, "BSD-2-Clause"),
    (("zlib-asis", "zlib-liability", "zlib-grant"), 3, "Zlib"), (("mpl-form", "mpl-copy"), 1, "MPL-2.0"), (("epl-1",), 1, "EPL-1.0"), (("epl-2",), 1, "EPL-2.0"), (("cc0-waive",), 1, "CC0-1.0"), (("reserved",), 1, "All-Rights-Reserved"),
    *(((f"{n}-{v.replace(' ', '.')}-{k}", "gnu-warranty", "gnu-see", "gnu-copy"), 1, f"{n.upper()}-{v.replace(' ', '.')}-{'or-later' if k == 'later' else 'only'}") for n, (_, vs) in _FAMILIES.items() for v in vs for k in ("later", "only")),
)
#: Verbs that a notice begins with.
VERBS = ("licensed", "licenced", "released", "distributed", "published", "available", "provided", "shared", "covered", "offered", "governed")
#: Words before a full stop that does not end a sentence.
ABBREVIATIONS = ("v", "ver", "vs", "no", "inc", "corp", "ltd", "co", "llc", "dr", "mr", "mrs", "ms", "st", "e.g", "i.e", "eg", "ie", "cf", "al", "etc", "art", "sec", "u.s", "approx", "jr", "sr", "prof", "univ", "dept", "c")
_NOISE = re.compile(r"[^a-z0-9+]+")
_MARK = re.compile(r"[ \t]*(?:(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--|\.\\\"|dnl|rem\b|>)[ \t]*)*(?:(?:\(?(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})[.)]|[-*•])[ \t]+)?", re.IGNORECASE)
_STOP = re.compile(r"[.!?]+[\"')\]”’]*(?=\s+[\"'(\[“‘]*[A-Z0-9À-Þ]|\s*$)|[;:](?=\s)")
SCHEMA = "licenses string, sentence_ids string, n_known long, spans string"


def normalise(sentence: str) -> str:
    return _NOISE.sub(" ", sentence.lower()).strip()


def _compiled(template: str) -> str:
    """A template as a regular expression over normalised text."""
    out = []
    for part in re.findall(r"\([^)]*\)|\[[^\]]*\]|[^ ]+", template):
        if part[0] in "([":
            options = "|".join(_compiled(o) for o in part[1:-1].split("|"))
            out.append(f"(?:{options}){'?' if part[0] == '[' else ''}")
        else:
            out.append(r"(?: \S+){1,12}?" if part == "<name>" else " " + re.escape(part))
    return "".join(out)


def _first_words(template: str) -> set[str] | None:
    """Words a sentence of this template can begin with; None for any."""
    head = re.match(r"\(([^)]*)\)|([^ ]+)", template)
    words = {o.split(" ")[0] for o in (head[1].split("|") if head[1] else [head[2]])}
    return None if "<name>" in words or template.startswith("[") else words


def _notice_id(m: re.Match, name: str) -> str:
    found = m.groupdict()
    v = (found.get("v") or "").replace(" ", ".")
    kind = found.get("kind") or ""
    kinds = [short for word, short in _KINDS if re.search(rf"\b{word}\b", kind)]
    kind = "".join(f"-{k}" for k in ("NC", "SA", "ND") if k in kinds)
    later = "-or-later" if found.get("later") else "-only"
    return "notice:" + name.format(v=v if "." in v else f"{v}.0", kind=kind, later=later)


class Recogniser:
    """Known sentences and notices, and the rules over their identifiers."""

    def __init__(self, sentences: dict[str, tuple[str, ...]], rules: tuple, notices: tuple = NOTICES):
        self.by_word: dict[str | None, list[tuple[re.Pattern, str]]] = {}
        self.longest = 1
        for name, many in sentences.items():
            for t in many:
                pattern = re.compile(_compiled(t))
                for word in _first_words(t) or (None,):
                    self.by_word.setdefault(word, []).append((pattern, name))
                self.longest = max(self.longest, len(t.split()) + 12 * t.count("<name>"))
        lead = r"(?<![a-z0-9+])(?<!not )(?:" + "|".join(VERBS) + r") (?:under|by|subject to)(?: an?| the)?(?: terms (?:and conditions )?of(?: an?| the)?)? "
        self.notices = [(re.compile(lead + f"(?:{p})" + (_LATER if "later" in n else "") + r"(?: (?:international|unported|generic))?(?: licen[sc]e)?(?![a-z0-9+])"), n) for p, n in notices]
        self.spdx = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()\- ]*[A-Za-z0-9.+)])")
        expanded = []
        for ids, least, licence in rules:
            expanded += [(tuple(ids[:k]), licence) for k in range(len(ids), least - 1, -1)]
        self.rules = sorted(enumerate(expanded), key=lambda r: (-len(r[1][0]), r[0]))
        self.anchors = anchors(sentences)

    def pieces(self, text: str) -> Iterator[list[tuple[str, int, int, bool]]]:
        """Blocks of pieces (normalised words, start, end, whether a sentence ends behind it). A piece ends at ; or : or with its line at the latest."""
        block: list[tuple[str, int, int, bool]] = []
        at = 0
        for line in text.split("\n"):
            x = at + _MARK.match(line).end()
            end = at + len(line)
            if not line[x - at :].strip(" \t\r*/-="):
                if block:
                    yield block
                block = []
            else:
                for stop in _STOP.finditer(line, x - at):
                    word = re.search(r"[^\s(\"']*$", line[: stop.start()])[0].lower()
                    if stop.end() < len(line.rstrip()) and (word in ABBREVIATIONS or len(word) == 1 and word.isalpha()):
                        continue
                    if words := normalise(line[x - at : stop.end()]):
                        # an abbreviation that ends its line may go on in the next
                        block.append((words, x, at + stop.end(), stop[0][0] not in ";:" and word not in ABBREVIATIONS))
                    x = at + stop.end()
                if words := normalise(line[x - at :]):
                    block.append((words, x, end, False))
            at = end + 1
        if block:
            yield block

    def identify(self, text: str) -> list[tuple[str, int, int]]:
        """(identifier, start, end) of the known sentences, in order of the text, by characters."""
        found = [(f"spdx:{m[1].strip()}", m.start(), m.end()) for m in self.spdx.finditer(text)]
        for block in self.pieces(text):
            if self.anchors:
                whole = " ".join(p[0] for p in block)
                if not any(a in whole for a in self.anchors):
                    continue
            i = 0
            while i < len(block):
                name, j = self._known(block, i)
                if name is None:
                    j = self._sentence_end(block, i)
                    hit = self._notice(" ".join(p[0] for p in block[i : j + 1]))
                    if hit is None:
                        i += 1
                        continue
                    # the lines that the notice needs
                    while i < j and self._notice(" ".join(p[0] for p in block[i + 1 : j + 1])) == hit:
                        i += 1
                    while j > i and self._notice(" ".join(p[0] for p in block[i:j])) == hit:
                        j -= 1
                    name = hit
                found.append((name, block[i][1], block[j][2]))
                i = j + 1
        return sorted(found, key=lambda f: f[1])

    def _known(self, block: list, i: int) -> tuple[str | None, int]:
        """The known sentence that begins with piece i and reaches furthest, and its last piece."""
        some = self.by_word.get(block[i][0].split(" ", 1)[0], []) + self.by_word.get(None, [])
        best, text, last = None, "", i
        for j in range(i, len(block)):
            text += " " + block[j][0]
            if text.count(" ") > self.longest:
                break
            for pattern, name in some:
                if pattern.fullmatch(text):
                    best, last = name, j
                    break
            if block[j][3]:
                break
        return best, last

    def _sentence_end(self, block: list, i: int) -> int:
        """The last piece of the sentence of piece i, three lines on at most, which any notice fits."""
        j = i
        while j + 1 < len(block) and not block[j][3] and j - i < 2:
            j += 1
        return j

    def _notice(self, sentence: str) -> str | None:
        hits = [(m.start(), -m.end(), k, m, n) for k, (p, n) in enumerate(self.notices) if (m := p.search(sentence))]
        if not hits:
            return None
        _, _, _, m, name = min(hits, key=lambda h: h[:3])
        return _notice_id(m, name)

    def match(self, ids: list[str]) -> list[tuple[str, int, int]]:
        """Licences with the places of their identifiers; identifiers that no rule takes are left out. Notices and tags name their licence themselves."""
        out, i = [], 0
        while i < len(ids):
            for _, (rule, name) in self.rules:
                if tuple(ids[i : i + len(rule)]) == rule:
                    out.append((name, i, i + len(rule)))
                    i += len(rule)
                    break
            else:
                if ids[i].startswith(("notice:", "spdx:")):
                    out.append((ids[i].partition(":")[2], i, i + 1))
                i += 1
        return out


def anchors(sentences: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    """Starts of words of which every known sentence, notice and tag holds one; none where a sentence has no long word."""
    out = ["licens", "licenc", "copyright", "rights reserved", "redistribut", "warrant", "permission", "unencumbered", "free software", *(f"{v} {w}" for v in VERBS[1:] for w in ("under", "by", "subject"))]
    for many in sentences.values():
        for t in many:
            plain = normalise(re.sub(r"\([^)]*\)|\[[^\]]*\]|<name>", " . ", t))
            if not any(f" {a}" in f" {plain}" for a in out):
                words = [w for w in plain.split() if len(w) > 3]
                if not words:
                    return ()
                out.append(max(words, key=len))
    return tuple(dict.fromkeys(out))


def any_start(starts: list[str]) -> str:
    """A pattern for a word that begins as one of `starts` do, tried letter by letter; between their words anything but letters may stand."""
    by_word: dict[str, set[str]] = {}
    for x in starts:
        word, _, rest = x.partition(" ")
        by_word.setdefault(word, set()).add(rest)
    by_letter: dict[str, list[str]] = {}
    for word, rests in sorted(by_word.items()):
        more = "" if "" in rests else "[^a-z0-9]+(?:" + "|".join(re.escape(r).replace(r"\ ", "[^a-z0-9]+") for r in sorted(rests)) + ")"
        by_letter.setdefault(word[0], []).append(re.escape(word[1:]) + more)
    return "(?<![a-z0-9])(?:" + "|".join(f"{re.escape(c)}(?:{'|'.join(w)})" for c, w in by_letter.items()) + ")"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict | None = None, rules: tuple | None = None) -> DataFrame:
    """One row per input row: id, licenses (distinct, in order, joined by +; null where none), sentence_ids (joined by ,; null where none), n_known, spans.

    spans lists licence:start-end, the characters from its first sentence to its
    last, joined by commas. Null and empty texts have none; null ids and repeated
    rows are scanned like others; where two rules fit, the longer holds, then the
    first; whole texts are read, very long ones too; other columns may have any
    names; an empty table stays empty.

    sentences: templates by identifier; rules: (identifiers, how many of them
    are enough, licence). Both replace the built-in ones; notices stay.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    # texts without a trace of a known sentence need not leave the JVM
    some = anchors(sentences)
    any_ = F.rlike(F.lower(F.col(text_col)), F.lit(any_start([*some, "spdx"]))) if some else F.lit(True)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rec = Recogniser(sentences, rules)
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                found = rec.identify(text) if isinstance(text, str) else []
                ids = [f[0] for f in found]
                hits = rec.match(ids)
                out.append((
                    "+".join(dict.fromkeys(h[0] for h in hits)) or None, ",".join(ids) or None, len(ids), ",".join(f"{n}:{found[a][1]}-{found[b - 1][2]}" for n, a, b in hits) or None,
                ))
            res = pd.DataFrame(out, columns=["licenses", "sentence_ids", "n_known", "spans"])
            res.insert(0, id_col, pdf["id"].to_numpy())
            yield res

    return docs.select(F.col(id_col).alias("id"), F.when(any_, F.col(text_col)).alias("text")).mapInPandas(run, f"`{id_col}` {kind}, {SCHEMA}")
