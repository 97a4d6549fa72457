"""op3_pii: what the generators propose, what the trees are taught, and what they then find."""

import pyarrow as pa
import pytest

from loomframe.llm import pii
from loomframe.llm.common import Texts

SPELLED = ["bob [at] site [dot] org", "bob [ at ] site [dot] org", "bob {At } site [ Dot ] org", "jane.doe(AT)example.com", "x" * 60 + " [ at ] " + "y" * 60 + " [dot] " + " [dot] ".join(["z" * 24] * 3)]
ACCOUNTS = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
NUMBERS = ["078-05-1120", "219-09-9999"]


def scan(*texts):
    return pii.Scan(Texts(pa.array(texts)))


def labels(*texts):
    s = scan(*texts)
    return {s.raw[a:b].decode(): y for (_, a, b), y in s.labelled().items()}


@pytest.mark.parametrize("span", SPELLED + ACCOUNTS + NUMBERS)
@pytest.mark.parametrize("text", ["{}", "see {}, or", "from 1990) {} THEN"])
def test_generators_propose_every_format(span, text):
    s = scan("a text in front 7", text.format(span), "9 and one behind")
    assert (1, len("a text in front 7") + text.index("{}"), len("a text in front 7") + text.index("{}") + len(span)) in s.candidates()


def test_formats_that_pass_their_check_are_no_negatives():
    for span in SPELLED + ACCOUNTS + NUMBERS:
        for text in ("{}", "see {}.", "account or mail: {};"):
            assert labels(text.format(span)).get(span) == 1, span
    assert labels("phone 415-555-0100")["415-555-0100"] == 1
    for span in ("DE88 3704 0044 0532 0130 00", "666-12-3456"):
        assert labels(f"account {span}")[span] == 0
    # other digit groups teach something in texts without cues alone
    assert labels("on 415 555 0100 x")["415 555 0100"] == 0
    assert "415 555 0100" not in labels("mail it, 415 555 0100 x")


def test_a_trained_model_finds_what_is_no_pattern(make, real):
    docs = real("documents", ["doc_id", "text"], "0.01")
    spans = SPELLED[:4] + ACCOUNTS + NUMBERS
    planted = [(10**6 + k, f"{lead} {span} and so on") for k, (lead, span) in enumerate((lead, span) for lead in ("reach me:", "mine is") for span in spans)]
    table = make(docs + planted)
    got = {r.doc_id: [text for text in r.pii if text.kind == "other"] for r in pii.scan_pii(table, pii.train(table)).collect()}
    missed = [text for k, text in planted if not any(text[s.start : s.end] in spans for s in got[k])]
    assert missed == []
