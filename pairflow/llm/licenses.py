"""License scans by ordered signature rules.

Every license of FAMILIES gives several signatures (identifier tag, grant sentence, name, address), some 300
regular expressions in all, ordered by priority. A rule runs only on texts that hold its keyword, found for all
rules in one pass of an Aho-Corasick automaton. Detections are resolved from the highest priority and the longest span down: one
that lies inside the interval of an accepted detection is suppressed, as "gpl" inside "lgpl 2.1" is. The score
is the confidence of the best detection that stays.

WORDING are signatures of the licence texts themselves, which usually do not name themselves: grants and conditions
rank above all names; PARTS (single conditions and disclaimers, which families share) count only in texts without
another licence. "All rights reserved" is a copyright notice and no licence where a licence is stated.

Beside the rules stand base phrases, whose places are counted on words: A-Z lower-cased,
`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Base labels always stay.

Results for odd input: null and empty texts have 0 words, no places, null positions, empty label strings and
score 0; repeated rows get a row each; a null id stays null; only the two named columns are read.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from pairflow.llm import textkit, worker

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double")
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# label: names as they are written (regular expressions), identifier, address or None. Order is priority:
# what is more specific comes first.
FAMILIES: list[tuple[str, str, str, str | None]] = [
    ("agpl-3.0", r"(?:gnu )?affero general public license(?:,? version 3| v3)?|agpl-?v?3(?:\.0)?", "agpl-3.0", "gnu.org/licenses/agpl"),
    ("agpl-1.0", r"affero general public license,? version 1", "agpl-1.0", None),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser|library) general public license,? (?:version |v)3|lgpl-?v?3(?:\.0)?", "lgpl-3.0", "gnu.org/licenses/lgpl-3"),
    ("lgpl-2.1", r"(?:gnu )?lesser general public license,? (?:version |v)2\.1|lgpl-?v?2\.1", "lgpl-2.1", "gnu.org/licenses/lgpl-2"),
    ("lgpl-2.0", r"(?:gnu )?library general public license(?:,? (?:version |v)2)?|lgpl-?v?2(?:\.0)?", "lgpl-2.0", None),
    ("lgpl", r"(?:gnu )?lesser general public license|\blgpl\b", "lgpl", "gnu.org/licenses/lgpl"),
    ("gfdl-1.3", r"gnu free documentation license,? version 1\.3", "gfdl-1.3", "gnu.org/licenses/fdl"),
    ("gfdl-1.2", r"gnu free documentation license,? version 1\.2", "gfdl-1.2", None),
    ("gpl-3.0", r"(?:gnu )?general public license,? (?:version |v)3|gpl-?v?3(?:\.0)?", "gpl-3.0", "gnu.org/licenses/gpl-3"),
    ("gpl-2.0", r"(?:gnu )?general public license,? (?:version |v)2|gpl-?v?2(?:\.0)?", "gpl-2.0", "gnu.org/licenses/old-licenses/gpl-2"),
    ("gpl-1.0", r"(?:gnu )?general public license,? (?:version |v)1|gpl-?v?1(?:\.0)?", "gpl-1.0", None),
    ("gpl", r"(?:gnu )?general public license|gnu gpl", "gpl", "gnu.org/copyleft/gpl"),
    ("apache-2.0", r"apache(?: software)? license,? (?:version |v)?2(?:\.0)?|apache-2(?:\.0)?", "apache-2.0", "apache.org/licenses/license-2.0"),
    ("apache-1.1", r"apache(?: software)? license,? (?:version |v)?1\.1", "apache-1.1", None),
    ("apache-1.0", r"apache(?: software)? license,? (?:version |v)?1(?:\.0)?", "apache-1.0", None),
    ("apache", r"apache(?: software)? license", "apache", "apache.org/licenses"),
    ("mit-0", r"mit no attribution|mit-0", "mit-0", None),
    ("mit", r"mit license|expat license", "mit", "opensource.org/licenses/mit"),
    ("x11", r"x11 license", "x11", None),
    ("bsd-4-clause", r"(?:original|old|4-clause|four-clause) bsd license|bsd[- ]4[- ]clause", "bsd-4-clause", None),
    ("bsd-3-clause", r"(?:new|modified|revised|3-clause|three-clause) bsd license|bsd[- ]3[- ]clause", "bsd-3-clause", "opensource.org/licenses/bsd-3-clause"),
    ("bsd-2-clause", r"(?:simplified|freebsd|2-clause|two-clause) (?:bsd )?license|bsd[- ]2[- ]clause", "bsd-2-clause", "opensource.org/licenses/bsd-2-clause"),
    ("0bsd", r"zero-clause bsd|bsd zero clause|\b0bsd\b", "0bsd", None),
    ("bsd", r"bsd(?:-style)? license", "bsd", "opensource.org/licenses/bsd-license"),
    ("isc", r"isc license", "isc", "opensource.org/licenses/isc"),
    ("mpl-2.0", r"mozilla public license,? (?:version |v)?2(?:\.0)?|mpl-?2(?:\.0)?", "mpl-2.0", "mozilla.org/mpl/2.0"),
    ("mpl-1.1", r"mozilla public license,? (?:version |v)?1\.1|mpl-?1\.1", "mpl-1.1", "mozilla.org/mpl/1.1"),
    ("mpl", r"mozilla public license", "mpl", "mozilla.org/mpl"),
    ("epl-2.0", r"eclipse public license,? (?:version |v)?2(?:\.0)?|epl-?2(?:\.0)?", "epl-2.0", "eclipse.org/legal/epl-2.0"),
    ("epl-1.0", r"eclipse public license,? (?:version |v)?1(?:\.0)?|epl-?1(?:\.0)?", "epl-1.0", "eclipse.org/legal/epl-v10"),
    ("epl", r"eclipse public license", "epl", None),
    ("cddl-1.1", r"common development and distribution license,? (?:version |v)?1\.1", "cddl-1.1", None),
    ("cddl-1.0", r"common development and distribution license", "cddl-1.0", None),
    ("cpl-1.0", r"common public license", "cpl-1.0", None),
    ("eupl-1.2", r"european union public licen[cs]e,? (?:version |v\. ?|v)?1\.2|eupl-?1\.2", "eupl-1.2", None),
    ("eupl", r"european union public licen[cs]e", "eupl", None),
    ("cecill", r"cecill(?:-[bc])?(?: (?:free software )?license)?", "cecill-2.1", "cecill.info"),
    ("artistic-2.0", r"artistic license,? (?:version |v)?2(?:\.0)?", "artistic-2.0", "opensource.org/licenses/artistic-license-2"),
    ("artistic", r"artistic license", "artistic-1.0", None),
    ("bsl-1.0", r"boost software license", "bsl-1.0", "boost.org/license_1_0"),
    ("busl-1.1", r"business source license", "busl-1.1", None),
    ("sspl-1.0", r"server side public license", "sspl-1.0", None),
    ("elastic-2.0", r"elastic license(?: 2\.0)?", "elastic-2.0", None),
    ("psf-2.0", r"python software foundation license|psf license", "psf-2.0", None),
    ("php-3.01", r"php license", "php-3.01", "php.net/license"),
    ("ruby", r"ruby license", "ruby", None),
    ("zlib", r"zlib(?:/libpng)? license", "zlib", "zlib.net/zlib_license"),
    ("libpng", r"libpng license|png reference library license", "libpng-2.0", None),
    ("openssl", r"openssl license", "openssl", None),
    ("curl", r"curl license", "curl", None),
    ("unlicense", r"\bthe unlicense\b|released into the public domain under the unlicense", "unlicense", "unlicense.org"),
    ("wtfpl", r"do what the f\*?u?c?k you want to public license|\bwtfpl\b", "wtfpl", "wtfpl.net"),
    ("cc0-1.0", r"cc0(?: 1\.0)?(?: universal)?|creative commons zero", "cc0-1.0", "creativecommons.org/publicdomain/zero"),
    ("cc-by-nc-nd-4.0", r"cc[- ]by-nc-nd(?: 4\.0|-4\.0)?|attribution-noncommercial-noderivatives", "cc-by-nc-nd-4.0", "creativecommons.org/licenses/by-nc-nd"),
    ("cc-by-nc-sa-4.0", r"cc[- ]by-nc-sa(?: 4\.0|-4\.0)?|attribution-noncommercial-sharealike", "cc-by-nc-sa-4.0", "creativecommons.org/licenses/by-nc-sa"),
    ("cc-by-nc-4.0", r"cc[- ]by-nc(?!-[sn][ad])(?: 4\.0|-4\.0)?|attribution-noncommercial(?!-)", "cc-by-nc-4.0", "creativecommons.org/licenses/by-nc/"),
    ("cc-by-nd-4.0", r"cc[- ]by-nd(?: 4\.0|-4\.0)?|attribution-noderivatives", "cc-by-nd-4.0", "creativecommons.org/licenses/by-nd"),
    ("cc-by-sa-4.0", r"cc[- ]by-sa(?: 4\.0|-4\.0)?|attribution-sharealike", "cc-by-sa-4.0", "creativecommons.org/licenses/by-sa"),
    ("cc-by-4.0", r"cc[- ]by(?!-)(?: 4\.0|-4\.0)?|creative commons attribution(?!-)", "cc-by-4.0", "creativecommons.org/licenses/by/"),
    ("cc", r"creative commons", "cc", "creativecommons.org/licenses"),
    ("odbl-1.0", r"open (?:data commons open )?database license|\bodbl\b", "odbl-1.0", "opendatacommons.org/licenses/odbl"),
    ("odc-by-1.0", r"open data commons attribution license|odc-by", "odc-by-1.0", "opendatacommons.org/licenses/by"),
    ("pddl-1.0", r"public domain dedication and license|\bpddl\b", "pddl-1.0", None),
    ("ofl-1.1", r"(?:sil )?open font license", "ofl-1.1", "scripts.sil.org/ofl"),
    ("ms-pl", r"microsoft public license|ms-pl", "ms-pl", None),
    ("ms-rl", r"microsoft reciprocal license|ms-rl", "ms-rl", None),
    ("afl-3.0", r"academic free license", "afl-3.0", None),
    ("osl-3.0", r"open software license", "osl-3.0", None),
    ("upl-1.0", r"universal permissive license", "upl-1.0", None),
    ("ncsa", r"university of illinois/ncsa open source license|ncsa license", "ncsa", None),
    ("postgresql", r"postgresql licen[cs]e", "postgresql", None),
    ("w3c", r"w3c software (?:notice and )?license", "w3c", None),
    ("vim", r"vim license", "vim", None),
    ("ecl-2.0", r"educational community license", "ecl-2.0", None),
    ("openrail", r"(?:bigscience )?open ?rail(?:-m)? license|\bopenrail(?:-m|\+\+)?\b", "openrail", None),
    ("llama", r"llama \d(?:\.\d)? community license", "llama", None),
    ("proprietary", r"proprietary and confidential|all rights reserved", "proprietary", None),
]
# form: (pattern around the name, identifier or address, confidence); the order is priority within a family.
FORMS = [
    ("identifier", r"spdx-license-identifier:? {{0,4}}{id}(?:-only|-or-later)?(?![\w.-])", 1.0),
    ("grant", r"(?:(?:licen[sc]ed|released|distributed|available|published|provided) (?:under|with) (?:the )?(?:terms (?:of )?the )?)(?:{name})", 0.95),
    ("address", r"https?://(?:www\.)?{url}", 0.9),
    ("sentence", r"(?:permission|subject to|see|read|under|comply with) (?:the )?(?:terms (?:of )?the )?(?:{name})", 0.85),
    ("name", r"(?<![\w-])(?:{name})(?![\w-])", 0.7),
]
_NEXT = r"[^a-z]+(?:(?:[a-d]|i{1,3}|iv)[^a-z]+)?"  # between clauses: their numbers or letters


def wording(*clauses: str) -> str:
    """The words of the clauses, whatever stands between them (line breaks, comment marks, quotes, numbers)."""
    return r"(?<![a-z])" + _NEXT.join(r"[^a-z]+".join(c.split()) for c in clauses) + r"(?![a-z])"


_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software"
_MIT_DOCS = _MIT + " and associated documentation files the software to deal"
_MIT_RIGHTS = (" in the software without restriction including without limitation the rights to use copy modify merge publish "
               "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so")
_ISC = "permission to use copy modify and(?:[^a-z]+or)? distribute this software for any purpose with or without fee is hereby granted"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted"
_BSD_SOURCE = "redistributions of source code must retain the(?:[^a-z]+above)? copyright notice this list of conditions and the following disclaimer"
_BSD_BINARY = ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
               "disclaimer in the documentation and or other materials provided with the distribution")
_BSD_BOTH = (_BSD + " provided that the following conditions are met", _BSD_SOURCE, _BSD_BINARY)
# (label, gate, pattern, confidence), what is more specific first.
WORDING = [
    ("mit-0", "hereby", wording(_MIT_DOCS + _MIT_RIGHTS, "the software is provided as is"), 0.95),
    ("ncsa", "hereby", wording(_MIT_DOCS + " with the software without restriction"), 0.95),
    ("mit", "hereby", wording(_MIT), 0.95),
    ("bsl-1.0", "hereby", wording("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"), 0.95),
    ("ofl-1.1", "hereby", wording("permission is hereby granted free of charge to any person obtaining a copy of the font software"), 0.95),
    ("0bsd", "hereby", wording(_ISC, "the software is provided as is"), 0.95),
    ("isc", "hereby", wording(_ISC), 0.95),
    ("postgresql", "hereby", wording("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"), 0.95),
    ("hpnd", "hereby", wording("permission to use copy modify(?:[^a-z]+and)? distribute(?:[^a-z]+and[^a-z]+sell)? this software and its documentation for any purpose(?:[^a-z]+and)?(?:[^a-z]+without[^a-z]+fee)? is hereby granted"), 0.95),
    ("bsd-4-clause", "redistribution", wording(*_BSD_BOTH, "all advertising materials mentioning features or use of this software must display"), 0.95),
    ("apache-1.1", "redistribution", wording(*_BSD_BOTH, "the end user documentation included with the redistribution"), 0.95),
    ("bsd-3-clause", "redistribution", wording(*_BSD_BOTH, "(?:neither[^a-z]+)?the names?"), 0.95),
    ("bsd-2-clause", "redistribution", wording(*_BSD_BOTH, "this software is provided"), 0.95),
    ("bsd", "redistribution", wording(_BSD), 0.9),
    ("zlib", "redistribute", wording("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"), 0.95),
    ("unlicense", "unencumbered", wording("this is free and unencumbered software released into the public domain"), 0.95),
]
PARTS = [
    ("mit", "substantial", wording("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"), 0.8),
    ("mit", "merchantability", wording("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"), 0.8),
    ("isc", "disclaims", wording("the software is provided as is and the author disclaims all warranties with regard to this software"), 0.8),
    ("bsd", "redistributions", wording(_BSD_SOURCE), 0.8),
    ("bsd", "redistributions", wording(_BSD_BINARY), 0.8),
    ("bsd", "merchantability", wording("this software is provided by the (?:copyright[^a-z]+holders?|authors?|regents|regents[^a-z]+and|copyright[^a-z]+holders?[^a-z]+and|authors?[^a-z]+and)(?:[^a-z]+contributors)? as is and any express or implied warranties including but not limited to the implied warranties of merchantability"), 0.8),
]
_FIRST, _LAST = -10_000, 100_000  # priorities of WORDING and PARTS: before and behind those of the families
# A text without any of these holds none of the names, identifiers and addresses above.
_KEYWORD = re.compile(r"[a-z0-9]{3,}")
_COMMON = {"license", "public", "general", "version", "software", "open", "the", "and", "terms", "https", "www", "org",
           "licenses", "source", "free", "com", "net", "html", "legal"}


def rules() -> list[tuple[int, str, str, float, re.Pattern]]:
    """(priority, label, keyword gate, confidence, pattern), highest priority (smallest number) first."""
    out = []
    for first, texts in ((_FIRST, WORDING), (_LAST, PARTS)):
        out += [(first + i, label, gate, confidence, re.compile(text)) for i, (label, gate, text, confidence) in enumerate(texts)]
    for family, (label, name, identifier, url) in enumerate(FAMILIES):
        for form, (kind, pattern, confidence) in enumerate(FORMS):
            if kind == "address" and url is None:
                continue
            text = pattern.format(name=name, id=re.escape(identifier), url=re.escape(url or ""))
            gate = {"identifier": "spdx", "address": (url or "").split("/")[0]}.get(kind, "")
            out.append((family * 10 + form, label, gate, confidence, re.compile(text)))
    return out


def gates(name: str) -> list[str]:
    """Substrings of which every match of a name holds one: a literal run of each alternative."""
    out, depth, start, parts = [], 0, 0, []
    for i, c in enumerate(name):
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            parts.append(name[start:i])
            start = i + 1
    for part in [*parts, name[start:]]:
        bare = re.sub(r"\\b|\\", " ", part)
        while re.search(r"\([^()]*\)[?*]?", bare):
            bare = re.sub(r"\([^()]*\)[?*]?", "|", bare)
        runs = [r for r in re.split(r"[|?*+\[\]]|(?<=\S)\?", re.sub(r".[?*]", "|", re.sub(r"\[[^\]]*\]", "|", bare))) if len(r.strip()) > 1]
        out.append(max((r.strip() for r in runs), key=len))
    return out


class Scanner:
    def __init__(self):
        self.rules = rules()
        by_gate: dict[str, set[int]] = {}
        for i, (priority, _, gate, _, _) in enumerate(self.rules):
            for g in [gate] if gate else gates(FAMILIES[priority // 10][1]):
                by_gate.setdefault(g, set()).add(i)
        self.automaton = ahocorasick.Automaton()
        for gate, chosen in by_gate.items():
            self.automaton.add_word(gate, chosen)
        self.automaton.make_automaton()
        sep = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
        self.base = [(re.compile(rb"(?<![0-9a-z\x80-\xff])" + (sep + b"+").join(w.encode() for w in phrase.split())
                                 + rb"(?![0-9a-z\x80-\xff])"), label) for phrase, label in BASE]
        self.word = np.zeros(256, dtype=bool)
        self.word[0x30:0x3A] = self.word[0x61:0x7B] = self.word[0x41:0x5B] = self.word[0x80:] = True

    def detections(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, label, confidence) that stay, of a lower-cased text."""
        wanted: set[int] = set()
        for _, chosen in self.automaton.iter(text):
            wanted |= chosen
        found = [(priority, m.start() - m.end(), m.start(), m.end(), label, confidence)
                 for priority, label, _, confidence, pattern in (self.rules[i] for i in sorted(wanted))
                 for m in pattern.finditer(text)]
        kept: list[tuple[int, int, str, float]] = []
        named = any(priority < _LAST and label != "proprietary" for priority, _, _, _, label, _ in found)
        for priority, _, start, end, label, confidence in sorted(found):
            if priority >= _LAST and named:
                continue
            if not any(a <= start and end <= b for a, b, _, _ in kept):
                kept.append((start, end, label, confidence))
        stated = any(label != "proprietary" and confidence >= 0.8 for _, _, label, confidence in kept)
        return [k for k in kept if not (stated and k[2] == "proprietary" and text[k[0]:k[1]].endswith("all rights reserved"))]

    def word_starts(self, data: np.ndarray) -> np.ndarray:
        inside = self.word[data]
        return np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))

    def base_places(self, data: bytes) -> list[tuple[int, str]]:
        """(byte, label) of every place of a base phrase in a lower-cased text."""
        if b"license" not in data:
            return []
        return [(m.start(), label) for pattern, label in self.base for m in pattern.finditer(data)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker.kept(("licenses",), Scanner)
        for batch in batches:
            rows = []
            for data in textkit.text_bytes(batch.column(1)):
                data = data.lower()  # of bytes: A-Z only
                starts = own.word_starts(np.frombuffer(data, dtype=np.uint8))
                places = own.base_places(data)
                at = np.searchsorted(starts, [p for p, _ in places])
                base = {label for _, label in places}
                found = own.detections(data.decode())
                score = max([c for *_, c in found] + [0.7 if places else 0.0])
                rows.append((len(starts), len(places), int(at.min()) if len(at) else None,
                             int(at.max()) if len(at) else None, ",".join(sorted(base)),
                             ",".join(sorted(base | {label for _, _, label, _ in found})), score))
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64())] + [pa.array(c, t) for c, t in zip(columns, types)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, RESULT)
