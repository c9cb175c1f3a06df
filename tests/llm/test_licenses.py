import random

import pytest
from docloom.llm.licenses import WORD, LicenseScanner, align, license_templates, longest_rise, scan_licenses, words_of

from .helpers import AWKWARD, doc_frame


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_longest_rise():
    rng = random.Random(1)
    for _ in range(100):
        values = [rng.randrange(20) for _ in range(rng.randrange(15))]
        picks = [values[i] for i in longest_rise(values)]
        assert picks == sorted(set(picks)) and len(picks) == lcs(values, sorted(set(values)))


def test_alignment_is_in_order_and_complete_for_unique_words():
    rng = random.Random(2)
    template = [b"t%d" % i for i in range(30)]
    for _ in range(50):
        text = [w for w in template if rng.random() < 0.8]
        for _ in range(5):
            text.insert(rng.randrange(len(text) + 1), b"other")
        pairs = align(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) == lcs(text, template)


def text_of(template):
    return b" ".join(template.words).decode()


def test_every_template_is_found_where_it_stands():
    scanner = LicenseScanner()
    rng = random.Random(3)
    filler = ["é%d" % i for i in range(50)] + ["the", "of", "a", "is", "under", "use"]
    for template in license_templates():
        text = text_of(template)
        before = " ".join(rng.choice(filler) for _ in range(60))
        whole = f"{before}\n{text.upper()}\n{before}. {text}"
        found = scanner.scan(whole)
        assert [x[2] for x in found] == [template.name] * 2, text
        assert whole[found[0][0] : found[0][1]] == text.upper() or found[0][3] < 1 or len(text) > found[0][1] - found[0][0]


@pytest.mark.parametrize(
    "text, names",
    [
        ("Released under the MIT License.", ["MIT"]),
        ("Released under the BSD License", []),
        ("Released under the BSD 2-Clause Licence", ["BSD-2-Clause"]),
        ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]),
        ("Licensed under CC BY-NC-SA 2.5.", ["CC-BY-NC-SA-2.5"]),
        ("Licensed under CC BY 3.0", ["CC-BY-3.0"]),
        ("Licensed under CC BY 5.0", []),
        ("Licensed under the Apache License, Version 1.1.", ["Apache-1.1"]),
        ("Licensed under the Apache License, Version 1.0.", []),
        ("Licensed under the GPL, version 2.", ["GPL-2.0"]),
        ("Licensed under the GNU Lesser GPL, version 3", ["LGPL-3.0"]),
        ("licensed under the GNU Library General Public License, version 2", []),
        ("licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ["CC-BY-ND-4.0"]),
        ("This is not released under the MIT license", []),
        ("It was never licensed under CC BY 4.0.", []),
        ("Not for sale. Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("Distributed under the GNU General Public License, version 2 or any later version.", ["GPL-2.0-or-later"]),
        ("We wrote about the MIT License and the Apache License.", []),
    ],
)
def test_distinguishing_words(text, names):
    assert [x[2] for x in LicenseScanner().scan(f"Some words before. {text}")] == names


def test_changed_words_lower_the_coverage():
    scanner = LicenseScanner()
    template = next(t for t in license_templates() if t.name == "GPL-3.0-or-later" and len(t.words) > 30)
    text = text_of(template).split()
    changed = [i for i in range(1, len(text), 8) if i not in template.needed]
    some = [w if i not in changed else "changed" for i, w in enumerate(text)]
    ((_, _, name, share),) = scanner.scan("x " + " ".join(some) + " y")
    assert name == "GPL-3.0-or-later" and 0.8 <= share < 1
    assert scanner.scan(" ".join(w if i % 2 else "changed" for i, w in enumerate(text))) == []


def everywhere(scanner, text):
    """The licenses of a text by aligning every template with the stretch around every word."""
    data = text.encode()
    words = words_of(data)
    spans = [m.span() for m in WORD.finditer(data)]
    regions = set()
    for t, template in enumerate(scanner.templates):
        slack = max(2, len(template.words) // 4)
        for p in range(len(words)):
            got = scanner.region(words, max(0, p - slack), min(len(words), p + len(template.words) + slack), t)
            if got and scanner._stands(data, words, spans, got, t):
                regions.add((got[0], got[1], got[2], t, got[3]))
    return scanner._spans(data, spans, sorted(regions))


def test_seeded_scan_equals_alignment_everywhere():
    rng = random.Random(8)
    every = license_templates()
    chosen = [t for t in every if t.name in ("MIT", "GPL-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "BSD-3-Clause", "Apache-2.0")]
    scanner = LicenseScanner(chosen)
    filler = ["w%d" % i for i in range(30)] + ["license", "under", "the", "version", "2.0", "of", "software"]
    draw = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    found = 0
    for _ in range(40):
        parts = []
        for template in rng.sample(chosen, 2):
            words = text_of(template).split()
            for _ in range(rng.randrange(1 + len(words) // 8)):
                i = rng.randrange(len(words))
                words[i : i + rng.choice([0, 1])] = [rng.choice(["changed", "not", "nd", "w1"])]
            parts += [draw(rng.randrange(1, 9)), " ".join(words)]
        text = ". ".join(parts)
        want = everywhere(scanner, text)
        got = scanner.scan(text)
        assert [x[2] for x in got] == [x[2] for x in want], text
        # the stretches differ in their borders, so a stray word before a region may fall to it or not
        assert all(a < d and c < b for (a, b, _, _), (c, d, _, _) in zip(got, want, strict=True)), text
        found += len(want)
    assert found >= 30


def test_rows(spark):
    rows = [*AWKWARD, (9, "a. Released under the MIT License. " * 3000), (10, "Licensed under CC BY-NC 4.0.")]
    got = scan_licenses(doc_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[9].n_licenses == 3000 and by[9].licenses == "MIT" and by[10].spans == "CC-BY-NC-4.0:0:27:1"
    assert all(by[i].n_licenses == 0 and by[i].spans == "" for i in (1, 2, 3, None, 5, 6))
    assert scan_licenses(doc_frame(spark, [])).count() == 0
