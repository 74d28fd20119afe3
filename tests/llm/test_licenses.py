"""License rules: each on texts made from its own expression, and lines as they are met."""

import random
import re
import time

import pytest

from folioscope.llm import licenses

try:
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_parse as parser

LINES = [
    ("Apache-2.0", {"apache-2.0"}), ("Licensed under Apache 2.0", {"apache-2.0"}), ("GPLv3", {"gpl-3.0"}), ("GPLv2 only", {"gpl-2.0"}), ("GPL-3.0+", {"gpl-3.0-or-later"}), ("gplv2+ code", {"gpl-2.0-or-later"}),
    ("LGPLv2.1 or later", {"lgpl-2.1-or-later"}), ("LGPL-2.1+", {"lgpl-2.1-or-later"}), ("GNU AGPLv3", {"agpl-3.0"}), ("SPDX-License-Identifier: Apache-2.0 OR MIT", {"apache-2.0", "mit"}),
    ("SPDX-License-Identifier: (MIT OR GPL-3.0-only)", {"mit", "gpl-3.0"}), ("SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2.0-or-later"}), ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}),
    ("SPDX-License-Identifier: CC-BY-SA-4.0", {"cc-by-sa-4.0"}), ("SPDX-License-Identifier: ISC AND Zlib", {"isc", "zlib"}), ("License: MIT", {"mit"}), ("released under the MIT", {"mit"}), ("BSD-2-Clause", {"bsd-2-clause"}),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", {"mpl-2.0"}), ("http://www.apache.org/licenses/LICENSE-2.0", {"apache-2.0"}),
    ("This is free and unencumbered software released into the public domain.", {"unlicense"}), ("https://creativecommons.org/publicdomain/zero/1.0/", {"cc0-1.0"}),
    ("The Software shall be used for Good, not Evil.", {"json"}), ("All rights reserved.", {"all-rights-reserved"}), ("Alle Rechte vorbehalten", {"all-rights-reserved"}),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", {"gpl-2.0-or-later"}),
    ("C++ and 2+2, mitigate, bsdiff, an apache helicopter", set()), ("2+ items of gpl 2", {"gpl-2.0"}), ("the gplx 3+", set()),
]


@pytest.mark.parametrize("text,wanted", LINES)
def test_lines(text, wanted):
    assert {d.label for d in licenses.scan_text(text)[5]} == wanted


def made(tree, draw):
    """A text that an expression matches."""
    out = []
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(arg))
        elif name == "IN":
            kind, x = draw.choice([a for a in arg if str(a[0]) != "NEGATE"])
            out.append(chr(x) if str(kind) == "LITERAL" else chr(draw.randint(*x)))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += [made(arg[2], draw) for _ in range(draw.randint(arg[0], min(arg[1], arg[0] + 2)))]
        elif name == "SUBPATTERN":
            out.append(made(arg[3], draw))
        elif name == "BRANCH":
            out.append(made(draw.choice(arg[1]), draw))
        else:
            assert name in ("ASSERT", "ASSERT_NOT"), name
    return "".join(out)


def test_each_rule_finds_what_it_describes():
    draw = random.Random(8)
    assert sum(1 for r in licenses.rules()) > 300
    for rule in licenses.rules():
        tree = parser.parse(rule.pattern.pattern.decode())
        for _ in range(6):
            text = re.sub(" +", " ", made(tree, draw) + " x ")
            if not rule.pattern.search(text.encode()):
                continue  # random words between may be what a look-ahead forbids
            assert any(f" {k.decode()}" in text for k in rule.keywords), (rule, text)
            found = licenses.detect(text.encode(), {k for k in licenses._prefilter()[1] if f" {k}" in text})
            assert found and (rule.label in {d.label for d in found} or max(d.end - d.start for d in found) >= 1), (rule, text)
        text = re.sub(" +", " ", made(tree, random.Random(1)) + " x ")
        assert rule.pattern.search(text.encode()) or "[a-z0-9" in rule.pattern.pattern.decode(), (rule, text)


def test_suppression_is_that_of_all_pairs():
    draw = random.Random(2)
    for _ in range(200):
        found = []
        for k in range(draw.randint(1, 30)):
            start = draw.randrange(30)
            found.append((start, start + draw.randint(1, 12), k, licenses.Rule("x", draw.randrange(4), re.compile(b"x"), (), 1.0)))
        order = sorted(found, key=lambda x: (x[3].priority, x[0] - x[1], x[2]))
        kept = []
        for x in order:
            if not any(y[0] <= x[0] and x[1] <= y[1] for y in kept):
                kept.append(x)
        assert sorted(x[2] for x in licenses._uncovered(list(found))) == sorted(x[2] for x in kept)


def test_a_long_text_full_of_licenses_is_linear():
    part, took = "under GPL-3.0+ or the Apache License, Version 2.0; MIT License, CC BY-SA 4.0, all rights reserved ", []
    for n in (3000, 12000):
        began = time.monotonic()
        got = licenses.scan_text(part * n)
        took.append(time.monotonic() - began)
        assert len(got[5]) == 5 * n and got[1] == 3 * n and got[2] == 6 and got[0] == 21 * n
    assert took[1] < 12 * took[0] + 2
