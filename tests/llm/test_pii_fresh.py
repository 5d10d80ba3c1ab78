"""The tagger on notations that no training form makes: what it finds and what it touches by mistake.

Written after training and never fed back: a notation that is missed here
stays missed until it is learned from other sources.
"""

import re

from pairmill.llm import pii, tagger

#: (sentence, the personal data in it)
FRESH = [
    ("ring 555 / 867 5309 after six", "555 / 867 5309"), ("tel 867-5309 ext. 12 please", "867-5309 ext. 12"), ("mail joe<at>site<dot>io today", "joe<at>site<dot>io"), ("mary{at}uni.example is mine", "mary{at}uni.example"), ("jane AT corp DOT com will do", "jane AT corp DOT com"),
    ("the box at 192-168-0-12 is up", "192-168-0-12"), ("it answers as fe80::1ff:fe23:4567:890a", "fe80::1ff:fe23:4567:890a"), ("charged 4012 88888888 1881 twice", "4012 88888888 1881"), ("my amex is 3782 822463 10005", "3782 822463 10005"), ("fon 0049(0)89/636-48018", "0049(0)89/636-48018"),
    ("text me: 44 20 7946 0958", "44 20 7946 0958"), ("gsm 06-12-34-56-78 merci", "06-12-34-56-78"), ("call 5 5 5 0 1 8 7 now", "5 5 5 0 1 8 7"), ("owner=bob|at|firm.example", "bob|at|firm.example"), ("0x7f.0x0.0x0.0x1 is home", "0x7f.0x0.0x0.0x1"), ("card no 5500,0000,0000,0004", "5500,0000,0000,0004"),
]
NONE = [
    "the 1,234,567 voters of 1984", "section 12.3.4.5 of the act", "score 21-14, 7-6, 3-3", "DOI 10.1000/182 appeared", "lot 4711-0815 shipped", "at 23:59 on 31/12/1999", "GTIN 4006381333931", "commit 3f2a9c1 broke it", "isbn 0-306-40615-2", "rated 4.5/5 by 1200", "meet @ 8 sharp", "15 km at 30 km/h", "IBAN check digits 82",
    "route 66 to mile 1234", "paragraphs 100 101 102 103", "a 16 bit word 0xFFFF", "temperature -12.5 to 37.8", "ratio 3:4:5 holds", "seed 20240915 run 7", "10 20 30 40 50 60",
]


def shapes():
    """Each training form as a pattern."""
    of = {"#": r"\d", "*": "[a-z]+", "&": "[0-9a-f]", "~": r"\d{1,3}", "$": r"\d{4}"}
    return [re.compile("".join(of.get(c, re.escape(c)) for c in form)) for forms in tagger._FORMS for form in forms]


def test_fresh_sentences():
    assert not [span for _, span in FRESH for p in shapes() if p.fullmatch(span.lower())]
    reader = tagger.Reader(tagger.train())
    own = pii.all_spans(reader, [t for t, _ in FRESH] + NONE)
    found = exact = 0
    for (text, span), (_, all_) in zip(FRESH, own):
        a = text.index(span)
        z = a + len(span)
        found += any(x[1] < z and x[2] > a for x in all_)
        exact += any((x[1], x[2]) == (a, z) for x in all_)
    touched = sum(len(all_) > len(base) for base, all_ in own[len(FRESH) :])
    print(f"fresh: {len(FRESH)} spans, {found} met, {exact} exactly; {len(NONE)} sentences without any, {touched} touched")
    assert touched <= 4 and found >= 4  # measured: 5 of 16 met, 2 of 20 touched
