"""Cases that a review found missing."""

import pytest

from twinfold.llm import op4_pii, op6_quality


def test_quality_limits_follow_spread(spark):
    """The same rates are kept where they are common and rejected where they aren't, for lines, repeats, symbols and long words."""

    def text(i, lines, symbols, repeats, long):
        words = [f"w{i:05d}x{j:03d}" + "y" * long for j in range(120)]
        for k in range(repeats):
            words[60 + 4 * k : 63 + 4 * k] = words[4 * k : 4 * k + 3]
        body = [" ".join(words[j : j + 12]) for j in range(0, 120, 12)]
        return "\n".join(body + ["same line"] * (lines + 1) * bool(lines) + ["$" * symbols] * bool(symbols))

    rows = [(i, text(i, i % 5, i % 9 * 3, i % 6, i % 4), "en", "wide") for i in range(400)]
    rows += [(1000 + i, text(i, 0, 0, 0, 0), "en", "narrow") for i in range(4000)]
    odd = [(4, 0, 0, 0), (0, 24, 0, 0), (0, 0, 5, 0), (0, 0, 0, 3)]
    rows += [(9000 + 10 * k + (s == "wide"), text(7, *o), "en", s) for k, o in enumerate(odd) for s in ("narrow", "wide")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    gone = {r.doc_id for r in op6_quality.judged(d).where("not kept").collect()}
    assert gone == {9000, 9010, 9020, 9030}


def found(text):
    return [(op4_pii.KINDS[k], text[a:z]) for k, a, z in op4_pii.spans(text)[1]]


@pytest.mark.parametrize("at", [" at ", " AT ", "  at\n", " arroba ", " @ ", " (at) ", "[@]"])
def test_pii_only_at_disguised(at):
    text = f"write to jane{at}example.com"
    assert found(text) == [("email", f"jane{at}example.com")]
    assert op4_pii.masked(text, op4_pii.spans(text)[1]) == "write to <EMAIL>"


@pytest.mark.parametrize(
    "address",
    ["bob [at] firma [dot] ru", "bob (at) firma.xyz", "bob at firma (dot) online", "bob [at] a-b [dot] co [dot] nz", "john [dot] smith [at] example [dot] com", "john dot q dot smith at example dot com", "john [dot] smith@example.com"],
)
def test_pii_any_label_and_local_dots(address):
    text = f"mail {address} , please"
    assert op4_pii.masked(text, op4_pii.spans(text)[1]) == "mail <EMAIL> , please"


def test_pii_bare_words_stay():
    assert found("we look at things dot that") == [] and found("write to bob at example dot com point taken") == [("email", "bob at example dot com")]


@pytest.mark.parametrize(
    ("kind", "text"),
    [("phone", "+49 one seven one five five five 2345"), ("card", "four three eight seven 5130 3523 7269"), ("card", "4387 5130 three five two three 7269"), ("ip", "one nine two dot one six eight dot one dot one"), ("ip", "192 dot one six eight dot 1 [dot] one")],
)
def test_pii_mixed_digits(kind, text):
    assert found(f"take {text} ok") == [(kind, text)]
