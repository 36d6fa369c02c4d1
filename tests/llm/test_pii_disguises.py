import time

from feedback_signals.llm import pii


def _added(text):
    return [(k, text[s:e]) for k, s, e, base in pii.spans(text) if not base]


def test_disguised_dots_between_digits_and_bracketed_at():
    for address in (
        "192[.]168[.]1[.]20", "192 dot 168 dot 1 dot 20", "192(dot)168.1 [dot] 20",
        "one nine two dot one six eight dot one dot two zero",
    ):
        assert _added(f"host {address} is up") == [("ip", address)], address
    for phone in ("+49 dot 176 dot 5555 dot 123", "+49[.]176[.]5555123", "plus four nine dot one seven six dot five five five five dot one two"):
        assert _added(f"call {phone} now") == [("phone", phone)], phone
    card = "four one one one one one one one one one one one one one one one"
    assert _added(f"card {card} ok") == [("card", card)]
    for mail in ("jane [@] mail.com", "jane(@)mail[.]com", "jane.doe <@> mail dot com"):
        assert _added(f"mail {mail} now") == [("email", mail)], mail


def test_other_numbers_stay_and_long_runs_take_linear_time():
    for clean in ("version 3 dot 5", "300 dot 1 dot 1 dot 1", "192.168.1.20 and 1.5", "one two dot three", "tag @ [ ] home"):
        assert _added(clean) == [], clean
    begin = time.time()
    for text in ("one " * 20_000, "1 dot " * 20_000, "1[.]" * 20_000, "one dot " * 20_000):
        pii.spans(text)
    assert time.time() - begin < 20
