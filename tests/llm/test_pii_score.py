"""Context words near a match raise its score; numbers of the social security form."""

import pytest

from gridloom.llm import pii


def test_scores_and_social_security_numbers(spark):
    texts = [
        "My social security number is 123-45-6789.", "order 123-45-6789 shipped", "social " + "x" * 60 + " 123-45-6789", "000-45-6789 and 123-00-6789 and 123-45-0000 and 666-45-6789",
        "a123-45-67890 1123-45-6789 123-45-6789-1", "SSN:\n219-09-9999, not 219-09-9998", None, "",
    ]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), kinds=("ssn",))
    got = {r.doc_id: [(r.text[s["start"] : s["end"]], round(s["score"], 3)) for s in r.pii_spans] for r in found.collect()}
    assert got[0] == [("123-45-6789", pytest.approx(0.6))] and got[1] == [("123-45-6789", pytest.approx(0.4))] and got[2] == [("123-45-6789", pytest.approx(0.4))]
    assert got[3] == [] and got[4] == [] and got[6] == [] and got[7] == []
    assert [t for t, _ in got[5]] == ["219-09-9999", "219-09-9998"] and got[5][0][1] == pytest.approx(0.6)
    row = pii.digest(pii.find(spark.createDataFrame([(1, "order 123-45-6789 and a.b@c.de")], "doc_id long, text string"))).first()
    assert row.spans == "ssn:6:17,email:22:30" and row.n_email == 1 and row.min_score == pytest.approx(0.4)
