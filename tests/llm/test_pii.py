import hashlib
import random
import re

import pytest

from strandline.llm import pii
from tests.llm.conftest import ODD

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            odd, even = digits[-1::-2], digits[-2::-2]
            luhn = (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice(["a", "b.c", "@", "@@", ".", "1", "42", "255.", "0", " ", "-", "+", "(", ")", "+1 ", "4111", "é"]) for _ in range(rng.randrange(30)))
        assert pii.base_spans(text) == brute(text), text


def test_cards_and_numbers():
    assert pii.base_spans("4111 1111 1111 1111") == [(0, 19, "card")]
    assert pii.base_spans("4111 1111 1111 1112") == []
    assert pii.base_spans("256.1.1.1 and 1.2.3.4.5.6.7.8") == brute("256.1.1.1 and 1.2.3.4.5.6.7.8")


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("mail john (at) example [dot] com today", "email", "john (at) example [dot] com"),
        ("write to jane dot doe at example dot org now", "email", "jane dot doe at example dot org"),
        ("ј.ѕmith＠ехample.com", "email", "ј.ѕmith＠ехample.com"),
        ("host １９２.168.1.1 up", "ip", "１９２.168.1.1"),
        ("ip is 10 dot 0 dot 0 dot 1 here", "ip", "10 dot 0 dot 0 dot 1"),
        ("call plus one four one five five five five two six seven one please", "phone", "plus one four one five five five five two six seven one"),
        ("pay four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, value):
    base, spans = pii.all_spans(text)
    assert base == [] and [(k, text[s:e]) for s, e, k in spans] == [(kind, value)]


@pytest.mark.parametrize("text", ["one two three go", "we met at noon", "the dot on the map", "look at one dot", "look at the dot com era", "version 2 dot 0 is out", "zero chance, one hope", "Привет, мир"])
def test_clean_prose_has_no_spans(text):
    assert pii.all_spans(text) == ([], [])


def test_base_spans_stay():
    text = "a@b.co and c (at) d.com"
    base, spans = pii.all_spans(text)
    assert set(base) < set(spans) and len(spans) == 2


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "@" * 100_000, "+1" * 100_000, "one " * 50_000, "a@" * 50_000, " " * 300_000 + "(at)", "(" * 300_000 + "at) dot", "a dot " * 50_000, "a at " * 50_000 + "dot", "[ " * 100_000 + "dot"):
        pii.all_spans(text)


def test_odd_rows(documents):
    got = pii.find_pii(documents(ODD)).collect()
    assert len(got) == len(ODD)
    none = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == none and r.spans == "" and r.n_email == 0 for r in got)
    assert pii.find_pii(documents(ODD).limit(0)).collect() == []


def test_span_rows(documents):
    got = pii.pii_spans(documents([(1, "x a@b.co"), (2, None)])).collect()
    assert [(r.doc_id, r.kind, r.start, r.end, r.value, r.disguised) for r in got] == [(1, "email", 2, 8, "a@b.co", False)]


def test_hosts_that_begin_with_an_article():
    assert pii.undo_signs("jane at my-mail dot com") == [(4, 8, "@"), (15, 20, ".")]
    assert pii.undo_signs("jane at the dot com") == []


@pytest.mark.parametrize(
    "text, value",
    [
        ("x jane@example dot com now", "jane@example dot com"),
        ("reach jane at example.com", "jane at example.com"),
        ("Jane Dot Doe At Example Dot Org", "Jane Dot Doe At Example Dot Org"),
        ("so x.y9 at mail.example.org is it", "x.y9 at mail.example.org"),
        ("a dot b dot c dot d dot e dot f dot g dot h dot i dot j dot k at mail dot example dot co dot uk please", "a dot b dot c dot d dot e dot f dot g dot h dot i dot j dot k at mail dot example dot co dot uk"),
    ],
)
def test_half_disguised_and_long_spoken_addresses(text, value):
    base, spans = pii.all_spans(text)
    assert base == [] and [(k, text[s:e]) for s, e, k in spans] == [("email", value)]


@pytest.mark.parametrize("text", ["it costs $19.99 at amazon.com", "version 3.2 at github.com", "open 24/7 at walmart.com", "ranked 5 at espn.com", "won 3-2 at nfl.com", "sat at table dot it was fun", "sits at desk dot in the corner", "release v3.2 at github.com", "in Q3 at example.com", "look at page dot com", "meet at noon dot now", "read more at example.com", "see us at example.com", "jane at the dot com", "the price at 5 dot 3", "open at 9.30 today", "it is sold at shop.example.com"])
def test_prose_around_at_and_dot(text):
    assert pii.all_spans(text) == ([], [])


def test_a_wider_disguised_span_is_added_to_the_plain_one():
    text = "to b\u043eb@example.com, now"  # a Cyrillic letter in the name
    base, spans = pii.all_spans(text)
    assert [text[s:e] for s, e, _ in base] == ["b@example.com"]
    assert [text[s:e] for s, e, _ in spans] == ["b\u043eb@example.com", "b@example.com"]
    for end in ("\u2013see", "\u3002", "\u2014 or"):  # punctuation that looks like a part of an address
        assert len(pii.all_spans(f"bob@example.com{end}")[1]) == 1


def test_long_spoken_runs_are_linear():
    for text in ("a at " * 60_000, "a dot " * 60_000 + "at b dot com", "a at b dot " * 40_000, "x@y dot " * 40_000, ".a" * 100_000 + " at b dot com", "b at " + "c." * 100_000):
        pii.all_spans(text)


@pytest.mark.parametrize(("text", "want"), [("mail kim at table dot it please", "kim at table dot it"), ("so kim.lee at table dot it is me", "kim.lee at table dot it"), ("so kim at mail dot co dot in", "kim at mail dot co dot in"), ("so 4711 at mail dot com", "4711 at mail dot com"), ("see k2 at mail.example.org", None), ("write k2 at mail.example.org", "k2 at mail.example.org"), ("e-mail 47 at mail.example.org", None)])
def test_addresses_that_look_like_prose(text, want):
    found = [text[s:e] for s, e, k in pii.all_spans(text)[1] if k == "email"]
    assert found == ([want] if want else [])
