import re

from eventide.llm import licenses
from tests.llm.helpers import awkward, empty


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, found = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += here
        found |= {label} if here else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found))


def test_base_counts_equal_brute_force(spark):
    texts = [
        "Released under the MIT License. mit license MIT-License", "cc by cc by-nc 4.0 CC BY", "Apache\nLicense é apache license2 apache license",
        "GNU General Public License gnu general public", "the license of mit", None, "", "CC", "by cc", "ccby ünder mit license",
    ]
    rows = list(enumerate(texts))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_suppression_and_priority():
    found = licenses.detections("this is licensed under the apache license, version 2.0. all rights reserved")
    assert [(r.label, r.priority) for _, _, r in found] == [("apache-2.0", 2), ("all-rights-reserved", 7)]
    assert licenses.detections("wir gehen mit ihm und unter mit") == []
    assert [r.label for _, _, r in licenses.detections("spdx-license-identifier: gpl-3.0-or-later")] == ["gpl-3.0"]


def test_rules_are_gated_by_words_they_need():
    assert len(licenses.RULES) > 300
    examples = ["spdx-license-identifier: {}", "licensed under the {} license", "covered by the {} license", "license: {}", "{} licensed", "under the {} license"]
    for name in ("mit", "bsd", "zlib", "cc0"):
        for e in examples:
            assert licenses.detections(e.format(name)), e.format(name)


def test_awkward_rows(spark):
    df = awkward(spark)
    assert licenses.scan(df).count() == df.count() and licenses.scan(empty(spark)).count() == 0


def example(pattern, space, longest):
    """A text that the regex matches, with `space` for white space and the first or last of its alternatives."""

    def text(items):
        out = ""
        for kind, value in items:
            kind = str(kind)
            if kind == "LITERAL":
                out += chr(value)
            elif kind == "MAX_REPEAT":
                least, most, body = value
                out += text(body) * max(least, int(longest and most > 0))
            elif kind == "BRANCH":
                out += text(value[1][-1 if longest else 0])
            elif kind == "SUBPATTERN":
                out += text(value[3])
            elif kind == "IN":
                first, of = value[0]
                out += space if str(first) == "CATEGORY" else chr(of[0] if str(first) == "RANGE" else of)
            else:
                assert kind == "ASSERT_NOT", kind
        return out

    return text(re._parser.parse(pattern.pattern))


def test_gated_rules_find_what_ungated_rules_find(monkeypatch):
    texts = [(rule, example(rule.pattern, space, longest)) for rule in licenses.RULES for space in (" ", "\n", "  ", "\u00a0") for longest in (False, True)]
    assert all(rule.pattern.fullmatch(text) for rule, text in texts)
    gated = [licenses.detections(text) for _, text in texts]
    monkeypatch.setattr(licenses, "_WORDS", ("",))
    monkeypatch.setattr(licenses, "_GATES", {("",): list(enumerate(licenses.RULES))})
    for (_, text), got in zip(texts, gated, strict=True):
        assert got and got == licenses.detections(text), text
