"""IBANs that are followed by capitals, digits or other IBANs."""

from gridloom.llm import pii


def test_iban_ends(spark):
    a, b, c, no = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "DE88370400440532013000"
    cases = [
        (f"{a} Bank", "[IBAN] Bank"), (f"{a} Please pay", "[IBAN] Please pay"), (f"to {b} BIC COBADEFF", "to [IBAN] BIC COBADEFF"), (f"{b} 2024-01-01.", "[IBAN] 2024-01-01."),
        (f"{a} {c} {b}", "[IBAN] [IBAN] [IBAN]"), (f"AB12 {a} 7", "AB12 [IBAN] 7"), (f"é {c}, X", "é [IBAN], X"), (f"{b}", "[IBAN]"), ("NO93 8601 1117 947 OSLO", "[IBAN] OSLO"),
        (f"MT84MALT011000012345MTLCAST001S {'A' * 40}", f"[IBAN] {'A' * 40}"), (f"{a}x {a}9 x{a} {no} BANK", f"{a}x {a}9 x{a} {no} BANK"),
    ]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(d, ("iban",)).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]
    near = spark.createDataFrame([(1, f"iban AB12 {a} X"), (2, f"{a} X {a}")], "doc_id long, text string")
    spans = {r.doc_id: [(s.start, s.end, s.score) for s in r.pii_spans] for r in pii.find(near, ("iban",)).collect()}
    assert spans == {1: [(10, 32, 1.0)], 2: [(0, 22, 0.8), (25, 47, 0.8)]}
