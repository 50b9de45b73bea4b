from __future__ import annotations

import hashlib
import re
from collections import Counter

from millrace.llm.disclosure import sanitise

#: The base patterns, by kind as listed.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in twice)) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


HARD = [
    "a@b.c_d@e.f 1.2.3.4.5.6.7.8 256.1.1.1 +1 (499) 555-6503x 4111 1111 1111 1111 é a.b@c-d.e", "@a.b a@b a@.b a@b.-.c x@y.z@w.v", "+1234567890-", "é" * 50 + "1.2.3.4",
    "1" * 30 + " 4111-1111-1111-1111 ", "\n\n a@b.co\n\nq", "\U0001f600 x@y.zz 中 1.1.1.1", "0001.02.3.0000255 1.2.3.0256", "9" * 5000, "a" * 5000 + "@b.c", "+1-" * 300, "1 " * 3000, None, "",
]


def test_base_spans(spark):
    rows = [(i, t) for i, t in enumerate(HARD)]
    got = {r.doc_id: r for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        found = base(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        counts = Counter(k for k, *_ in found)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (t, text, got[i].spans)
        assert tuple(got[i])[1:5] == tuple(counts[k] for k in PATTERNS) and got[i].spans.startswith(text)


def test_terms_that_only_stand_with_an_entity(spark):
    rows = [(i, f"write to ann@x.org about zorblax now\nthe other line {i}") for i in range(5)]
    rows += [(100 + i, f"about now the line of other things {i}") for i in range(60)]
    got = {r.doc_id: r for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    text = rows[0][1]
    at = text.index("zorblax")
    assert f"term:{at}:{at + 7}" in got[0].spans and "[EMAIL]" in got[0].sanitised and "zorblax" not in got[0].sanitised and "about" in got[0].sanitised
    assert all(got[100 + i].n_terms == 0 and got[100 + i].sanitised == rows[5 + i][1] for i in range(60))
    few = {r.doc_id: r for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string"), min_support=6).collect()}
    assert all(r.n_terms == 0 for r in few.values())


def test_an_entity_of_one_document_has_terms(spark):
    rows = [(0, "write to bob@x.org about quixotry now")]
    rows += [(100 + i, f"write to nobody about the line now {i}") for i in range(60)]
    got = {r.doc_id: r for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert got[0].n_terms == 1 and got[0].sanitised == "write to [EMAIL] about [TERM] now"
    assert all(got[100 + i].n_terms == 0 for i in range(60))


def test_document_counts_are_distinct_by_id_and_form(spark):
    forms = "mail eve@x.org about Plugh plugh, (PLUGH) now"
    rows = [(i, forms) for i in range(5)] + [(7, forms), (7, forms + " again"), (None, "about now"), (None, "about now")]
    rows += [(100 + i, f"mail about the line now again {i}") for i in range(60)]
    got = sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.n_terms for r in got if r.doc_id is not None and r.doc_id < 100] == [3] * 7
    assert all(r.n_terms == 0 for r in got if r.doc_id is None or r.doc_id >= 100)


def test_terms_anywhere_in_any_document(spark):
    far = "mail joe@x.org now\n" + "the line of things " * 90 + "\nthen (Xyzzy), é 😀 xyzzy!"
    rows = [(i, far) for i in range(5)] + [(50, "things of\nthe xyzzy line"), (None, "now Xyzzy"), (50, "other things")]
    rows += [(100 + i, f"now mail then the line of things other é 😀 {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sanitise(docs, with_text=True).collect()
    at = far.index("(Xyzzy)")
    for r in got:
        if r.doc_id is not None and r.doc_id < 5:
            assert r.spans == f"email:5:14,term:{at}:{at + 8},term:{len(far) - 6}:{len(far)}" and r.sanitised.endswith("then [TERM] é 😀 [TERM]")
    others = sorted((r.sanitised, r.n_terms) for r in got if r.doc_id is None or r.doc_id == 50)
    assert others == [("now [TERM]", 1), ("other things", 0), ("things of\nthe [TERM] line", 1)] and len(got) == len(rows)
    assert all(r.n_terms == 0 for r in got if r.doc_id is not None and r.doc_id >= 100)


def test_odd_rows(spark, odd, odd_rows):
    got = Counter((r.doc_id, r.base_sha256) for r in sanitise(odd).collect())
    assert got == Counter((i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base(t)).encode()).hexdigest()) for i, t, *_ in odd_rows)
    assert sanitise(odd.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, odd):
    plan = sanitise(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
