"""Gates derived from the rules leave out no text that a rule matches."""

import random
import re

from chronoweave.llm import license_scan


def example(rule: str, rng: random.Random) -> str:
    """A text that the rule matches: one of its alternatives at random."""
    while m := re.search(r"\(([^()]*)\)(\??)", rule):
        rule = rule[: m.start()] + ("" if m[2] and rng.random() < 0.5 else rng.choice(m[1].split("|"))) + rule[m.end() :]
    words = [w for w in rule.split(" ") if w]
    words = [w.rstrip("?") for w in words if not (w.endswith("?") and rng.random() < 0.5)]
    return " ".join("1999" if w == "YEAR" else w for w in words if w[0] != "~")


def test_needed_words():
    assert license_scan.needed("licensed under") == {"licensed"}
    assert license_scan.needed("(a|bb)? (cc|dd ee) ~3 f?") == {"cc", "dd"}
    for r in license_scan.rules():
        assert r["ks"]


def test_derived_gates_miss_nothing(spark):
    rng = random.Random(1)
    texts = ["released under the WTFPL", "published under the zlib", "available under the terms of the expat", "CC BY SA 4.0", "cc zero", "distributed under BSD", "psf license", "this photo is under CC BY-SA 4.0"]
    raw = [rule for _, _, _, rule in license_scan.TEXTS]
    for label, _, name in license_scan.NAMES:
        raw += [form.replace("{N}", f"({name})") for _, _, form in license_scan.FORMS]
    texts += [example(rule, rng) for rule in raw for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r for r in license_scan.scanned(docs, gates=None).collect()}
    compiled = [re.compile(r["r"].replace("[0-9]++", "[0-9]+")) for r in license_scan.rules()]
    for i, t in enumerate(texts):
        tagged = " " + "".join(f"{w}:{k} " for k, w in enumerate(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())))
        assert bool(got[i].detections) == any(c.search(tagged) for c in compiled), t
    assert all(got[i].detections for i in range(8))


def test_license_clashes(spark):
    docs = spark.createDataFrame([(1, "MIT License", 5, 6, 7, 8)], "doc_id long, text string, _low int, _hit int, _tagged int, _found int")
    r = license_scan.scanned(docs).first()
    assert (r._low, r._hit, r._tagged, r._found) == (5, 6, 7, 8) and len(r.places) == 1
