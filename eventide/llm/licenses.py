"""Licence statements in texts by ordered signature rules.

Method: hundreds of regexes, made of the licences' names and the wordings that state a licence, are gated by
keywords: a rule runs only on texts that hold its keyword, over any white space. Detections carry their rule's priority; where detections
overlap, one contained in another of the same or a higher priority is suppressed, and so is the lower of two that
cover the same span. Base phrases are counted apart, on word sequences, and keep their labels whatever the rules find.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm import text_kernel as tk

#: Phrases whose words are counted wherever they stand consecutively, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label: (keyword of every one of its names, names as regexes on lower-cased text)
NAMES = {
    "mit": ("mit", [r"mit(?:/expat)?", r"mit-0", r"mit/x11"]),
    "expat": ("expat", [r"expat"]),
    "apache": ("apache", [r"apache", r"apache software", r"apache public"]),
    "apache-2.0": ("apache", [r"apache[- ]?(?:license,? ?)?(?:version |v\.? ?)?2(?:\.0)?", r"apache-2\.0"]),
    "apache-1.1": ("apache", [r"apache[- ]?(?:license,? ?)?(?:version |v\.? ?)?1\.1", r"apache-1\.1"]),
    "gpl": ("gpl", [r"(?:gnu )?gpl"]),
    "gpl-long": ("general public", [r"gnu general public", r"general public"]),
    "gpl-2.0": ("gpl", [r"(?:gnu )?gpl[- ]?(?:version |v\.? ?)?2(?:\.0)?(?:-only|-or-later|\+)?"]),
    "gpl-3.0": ("gpl", [r"(?:gnu )?gpl[- ]?(?:version |v\.? ?)?3(?:\.0)?(?:-only|-or-later|\+)?"]),
    "lgpl": ("lgpl", [r"(?:gnu )?lgpl(?:[- ]?v?\.? ?[23](?:\.[01])?)?(?:-only|-or-later|\+)?"]),
    "lgpl-long": ("general public", [r"(?:gnu )?lesser general public", r"(?:gnu )?library general public"]),
    "agpl": ("agpl", [r"(?:gnu )?agpl(?:[- ]?v?\.? ?3(?:\.0)?)?(?:-only|-or-later|\+)?"]),
    "agpl-long": ("general public", [r"(?:gnu )?affero general public"]),
    "gfdl": ("free documentation", [r"gnu free documentation"]),
    "bsd": ("bsd", [r"bsd", r"bsd[- ]style"]),
    "bsd-2-clause": ("bsd", [r"(?:simplified|freebsd|2-clause|two-clause) bsd", r"bsd[- ]2(?:-clause)?"]),
    "bsd-3-clause": ("bsd", [r"(?:modified|new|revised|3-clause|three-clause) bsd", r"bsd[- ]3(?:-clause)?"]),
    "bsd-4-clause": ("bsd", [r"(?:original|old|4-clause|four-clause) bsd", r"bsd[- ]4(?:-clause)?"]),
    "mpl": ("mozilla", [r"mozilla public"]),
    "mpl-2.0": ("mpl", [r"mpl(?:[- ]?v?\.? ?(?:2\.0|1\.1))?"]),
    "epl": ("eclipse", [r"eclipse public", r"eclipse distribution"]),
    "cddl": ("common development", [r"common development and distribution"]),
    "isc": ("isc", [r"isc"]),
    "isc-long": ("systems consortium", [r"internet systems consortium"]),
    "zlib": ("zlib", [r"zlib", r"zlib/libpng"]),
    "boost": ("boost", [r"boost software", r"boost"]),
    "unlicense": ("unlicense", [r"unlicense"]),
    "wtfpl": ("wtfpl", [r"wtfpl"]),
    "artistic": ("artistic", [r"artistic", r"perl artistic", r"artistic[- ]2\.0"]),
    "python": ("python", [r"python software foundation", r"python"]),
    "postgresql": ("postgresql", [r"postgresql"]),
    "openssl": ("openssl", [r"openssl"]),
    "eupl": ("european union public", [r"european union public"]),
    "ofl": ("open font", [r"sil open font", r"open font"]),
    "odbl": ("open database", [r"open database", r"open data commons open database"]),
    "cc0": ("cc0", [r"cc0(?:[- ]1\.0)?"]),
    "cc-by": ("cc", [r"cc[- ]by(?:[- ][1-4]\.0)?"]),
    "cc-by-sa": ("cc", [r"cc[- ]by[- ]sa(?:[- ][1-4]\.0)?"]),
    "cc-by-nc": ("cc", [r"cc[- ]by[- ]nc(?:[- ][1-4]\.0)?"]),
    "cc-by-nd": ("cc", [r"cc[- ]by[- ]nd(?:[- ][1-4]\.0)?"]),
    "cc-by-nc-sa": ("cc", [r"cc[- ]by[- ]nc[- ]sa(?:[- ][1-4]\.0)?"]),
    "cc-by-nc-nd": ("cc", [r"cc[- ]by[- ]nc[- ]nd(?:[- ][1-4]\.0)?"]),
    "cc-long": ("creative commons", [r"creative commons attribution", r"creative commons"]),
}
#: Labels of long names are those of the short ones.
SAME = {"gpl-long": "gpl", "lgpl-long": "lgpl", "agpl-long": "agpl", "isc-long": "isc", "cc-long": "creative-commons"}

#: Names that are also ordinary words: only a wording that says licence counts for them.
ORDINARY = {"mit", "expat", "isc", "isc-long", "zlib", "boost", "artistic", "python", "postgresql"}
_LICENCE = r"[- ]licen[sc]ed?"

#: (priority, words one of which the wording holds, wording around a name, confidence); a lower number is stronger.
WORDINGS = (
    (1, ("spdx",), r"spdx-license-identifier: ?{name}", 1.0),
    (2, ("under",), r"(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{name}{licence}", 0.95),
    (3, ("subject", "covered", "governed", "terms"), r"(?:subject to|covered by|governed by|terms of) the {name}{licence}", 0.9),
    (4, ("licen",), r"licen[sc]ed?: ?{name}", 0.9),
    (5, ("licen",), r"{name}[- ]licen[sc]ed?", 0.8),
    (6, ("under",), r"under (?:the )?{name}{licence}", 0.6),
)
#: Statements without a licence's name: (label, priority, keyword, regex, confidence)
STATEMENTS = (
    ("all-rights-reserved", 7, "all rights reserved", r"all rights reserved", 0.5),
    ("copyright", 8, "copyright", r"copyright (?:\(c\) |© ?)?(?:19|20)[0-9]{2}", 0.4),
    ("public-domain", 4, "public domain", r"(?:dedicated|released) (?:in)?to the public domain", 0.9),
    ("public-domain", 6, "public domain", r"(?:in|is) (?:the )?public domain", 0.6),
    ("mit", 2, "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy", 0.95),
    ("isc", 2, "permission to use", r"permission to use, copy, modify, and/or distribute this software for any purpose", 0.95),
    ("bsd", 2, "and use in source", r"redistributions? and use in source and binary forms", 0.95),
    ("gpl", 2, "free software", r"this program is free software[:;] you can redistribute it and/or modify", 0.9),
    ("cc-by", 3, "creativecommons.org", r"creativecommons\.org/licenses/by/[1-4]\.0", 0.95),
    ("cc-by-sa", 3, "creativecommons.org", r"creativecommons\.org/licenses/by-sa/[1-4]\.0", 0.95),
    ("cc-by-nc", 3, "creativecommons.org", r"creativecommons\.org/licenses/by-nc/[1-4]\.0", 0.95),
    ("apache-2.0", 3, "apache.org/licenses", r"apache\.org/licenses/license-2\.0", 0.95),
    ("gpl", 3, "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?gpl", 0.9),
)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: tuple[str, ...]
    """The rule runs only on a text that holds the first of these and, if there are more, one of the others, where any white space counts as one space."""
    pattern: re.Pattern
    confidence: float


def _pattern(text: str) -> re.Pattern:
    return re.compile(rf"(?<!\w){text.replace(' ?', chr(0)).replace(' ', chr(1)).replace(chr(0), '[ ]?').replace(chr(1), r'\s+')}(?!\w)")


def rules() -> list[Rule]:
    """All rules in order: by priority, then as written."""
    out = [Rule(label, priority, (keyword,), _pattern(text), sure) for label, priority, keyword, text, sure in STATEMENTS]
    for label, (keyword, names) in NAMES.items():
        licence = _LICENCE if label in ORDINARY else f"(?:{_LICENCE})?"
        for name in names:
            for priority, words, wording, sure in WORDINGS:
                text = wording.replace("{licence}", licence).replace("{name}", f"(?:{name})")
                out.append(Rule(SAME.get(label, label), priority, (keyword, *words), _pattern(text), sure))
    return sorted(out, key=lambda r: r.priority)


RULES = rules()
_GATES = {g: [(i, r) for i, r in enumerate(RULES) if r.keywords == g] for g in dict.fromkeys(r.keywords for r in RULES)}
_WORDS = tuple(dict.fromkeys(w for g in _GATES for w in g))


def detections(text: str) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) of a lower-cased text, by start, after suppression."""
    spaced = " ".join(text.split())
    there = {w for w in _WORDS if w in spaced}
    found = []
    for gate, gated in _GATES.items():
        if gate[0] in there and (len(gate) == 1 or not there.isdisjoint(gate[1:])):
            found += [(m.start(), m.end(), i) for i, rule in gated for m in rule.pattern.finditer(text)]
    kept: list[tuple[int, int, Rule]] = []
    open_ = []  # kept detections that may contain a later one
    for start, end, i in sorted(found, key=lambda d: (d[0], -d[1], d[2])):
        open_ = [d for d in open_ if d[1] > start]
        if not any(end <= d[1] and d[2].priority <= RULES[i].priority for d in open_):
            kept.append((start, end, RULES[i]))
            open_.append(kept[-1])
    return kept


def _phrase_hashes() -> list[tuple[str, np.ndarray]]:
    out = []
    for phrase, label in BASE.items():
        data = np.frombuffer(phrase.encode(), np.uint8)
        starts, ends, _ = tk.words(data, np.array([0, len(data)]), tk.WORD)
        out.append((label, tk.span_hashes(tk.prefix_hashes(data), starts, ends)))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every whole text.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, after lower-casing A-Z. n_base
    counts every place of a base phrase, first_word and last_word are the smallest and largest word number of such a place, else
    null. labels joins base labels and those of the rules; both are distinct, sorted and comma-joined. score is the highest confidence
    of what was found (a base phrase: 0.8), 0 for nothing. Null text is empty text. Repeated rows are kept, other columns left
    behind; an empty table gives an empty one.
    """
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _phrase_hashes()
        for batch in batches:
            texts = batch.column(1)
            for first, end, data, offsets in tk.chunks(texts):
                n = end - first
                lowered = tk.LOWER[data]
                starts, ends, doc = tk.words(lowered, offsets, tk.WORD)
                n_words = np.bincount(doc, minlength=n)
                at = np.cumsum(n_words) - n_words
                hashes = tk.span_hashes(tk.prefix_hashes(lowered), starts, ends)
                n_base = np.zeros(n, np.int64)
                low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                base: dict[int, set[str]] = {}
                for label, phrase in phrases:
                    where = np.flatnonzero(hashes == phrase[0])
                    where = where[where + len(phrase) <= len(hashes)]
                    for step, h in enumerate(phrase[1:], 1):
                        where = where[(hashes[where + step] == h) & (doc[where + step] == doc[where])]
                    of, place = doc[where], where - at[doc[where]]
                    np.add.at(n_base, of, 1)
                    np.minimum.at(low, of, place)
                    np.maximum.at(high, of, place)
                    for d in np.unique(of).tolist():
                        base.setdefault(d, set()).add(label)
                labels, score = [""] * n, np.zeros(n)
                for d in range(n):
                    own = base.get(d, set())
                    text = lowered[offsets[d] : offsets[d + 1]].tobytes().decode()
                    found = detections(text)
                    labels[d] = ",".join(sorted(own | {r.label for _, _, r in found}))
                    score[d] = max([0.8 if own else 0.0, *(r.confidence for _, _, r in found)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n), pa.array(n_words), pa.array(n_base), pa.array(low, mask=n_base == 0), pa.array(high, mask=n_base == 0),
                        pa.array([",".join(sorted(base.get(d, ()))) for d in range(n)]), pa.array(labels), pa.array(score),
                    ],
                    names,
                )

    kinds = ["long"] * 5 + ["string"] * 2 + ["double"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, ", ".join(f"{c} {t}" for c, t in zip(names, kinds, strict=True)))
