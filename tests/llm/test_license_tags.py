from __future__ import annotations

import random
import re
import time

from tests.llm.fixtures import documents

from heliograph.llm import license_scan


def test_every_tag_of_a_line_is_read(spark):
    rows = [(1, "SPDX-License-Identifier: MIT code SPDX-License-Identifier: GPL-3.0-only more spdx-license-identifier : Zlib"), (2, "SPDX-License-Identifier: MIT OR SPDX-License-Identifier: ISC"), (3, "SPDX-License-Identifier:\nSPDX-License-Identifier: MIT")]
    got = {r.doc_id: (r.labels, r.permitted) for r in license_scan.scan(documents(spark, rows)).collect()}
    assert got == {1: ("gpl-3.0-only,mit,zlib", False), 2: ("isc,mit", True), 3: ("mit", True)}


def test_a_text_of_very_many_places():
    text = "x cc by nc é " * 400_000
    began = time.perf_counter()
    find = license_scan.automaton().iter
    words = text.encode().translate(license_scan.ALNUM_TRANSLATE).split()
    got = license_scan.scanned(text, f" {b' '.join(words).decode()} ", len(words), find)
    assert got[:4] == (2_000_000, 400_000, 1, 1_999_996) and time.perf_counter() - began < 20


def test_labels_score_and_verdict_equal_brute_force(spark):
    rng = random.Random(8)
    parts = [*license_scan.BASE, *license_scan.NOTICES, "SPDX-License-Identifier: MIT OR GPL-2.0-only\n", "spdx-license-identifier: (ISC AND Zlib)\n", "word", "license", ".", "mit"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(300)]
    got = {r.doc_id: r for r in license_scan.scan(documents(spark, rows)).collect()}
    for i, text in rows:
        words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())
        places = [(k, p) for p in {*license_scan.BASE, *license_scan.NOTICES, license_scan.TAG} for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        labels = {license_scan.BASE.get(p) or license_scan.NOTICES[p] for _, p in places if p != license_scan.TAG}
        tags = sum(p == license_scan.TAG for _, p in places)
        one, other = text.count("MIT OR GPL"), text.count("ISC AND Zlib")
        labels |= {"mit", "gpl-2.0-only"} if one else set()
        labels |= {"isc", "zlib"} if other else set()
        base = sorted(k for k, p in places if p in license_scan.BASE)
        assert (got[i].n_base, got[i].first_word, got[i].last_word) == (len(base), base[0] if base else None, base[-1] if base else None)
        assert got[i].labels == ",".join(sorted(labels)) and got[i].score == 1 - 0.5 ** (len(places) + tags)
        assert got[i].permitted is (True if one or other else None)
