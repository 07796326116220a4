import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import pii as P

PIECES = ["a.b@c.de", "@", ".", "x", "1", " ", "-", "192.168.0.1", "256.1.1.1", "4845168114407329", "4845 1681 1440 7329", "+1 (017) 555-7713", "+", "12", "é", "\n", "j_o%h+n@mail-1.example.com", "(", ")", "00001.2.3.4", "😀"]


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    """The base contract by plain regexes."""
    found = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


def test_base_spans_match_plain_regexes():
    pick = random.Random(3)
    for _ in range(2000):
        text = "".join(pick.choice(PIECES) for _ in range(pick.randint(0, 14)))
        assert P.detect(text) == brute(text), text
        assert [s[:3] for s in P.spans_of(text) if s[3]] == brute(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=16).map("".join))
def test_property(text):
    assert P.detect(text) == brute(text)


def test_disguises_map_back_to_source_characters():
    for text, span, kind in [
        ("x john (at) example (dot) com!", "john (at) example (dot) com", "email"),
        ("write jane at example dot com please", "jane at example dot com", "email"),
        ("jоhn@exаmple.com", "jоhn@exаmple.com", "email"),
        ("to jo​hn@exam.com.", "jo​hn@exam.com", "email"),
        ("１９２.168.0.1", "１９２.168.0.1", "ip"),
        ("call plus one four one five five five five one two three four now", "plus one four one five five five five one two three four", "phone"),
    ]:
        found = [(P.KINDS[k], text[a:b]) for k, a, b, base in P.spans_of(text) if not base]
        assert (kind, span) in found, (text, found)


def test_clean_text_has_no_spans():
    for text in ["look at the dot com", "see (at) the end", "one two three", "À la carte: été", "version 3.2", "4 at 5 dot 6", "un, deux, trois", "dos o tres puntos", "null und acht", "el punto (at) final", ""]:
        assert P.spans_of(text) == []


def test_long_runs_take_linear_time():
    for text in ["a" * 400_000, "1" * 400_000, "@" * 100_000, "+1" + " " * 200_000, "1." * 100_000, "a@" * 100_000]:
        P.spans_of(text)


def test_nulls_clashing_columns_and_masking(spark):
    rows = [(1, None, 0, 5), (2, "", 0, 0), (3, "mail a@b.cd or a@b.cd", 21, 21), (3, "mail a@b.cd or a@b.cd", 21, 21)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int, n_chars long")
    out = {(r.doc_id, r.n_email, r.spans) for r in P.digest(P.scan(df)).collect()}
    assert out == {(1, 0, ""), (2, 0, ""), (3, 2, "email:5:11,email:15:21")}
    assert P.scan(df.limit(0)).count() == 0
    masked = P.redact(df)
    assert masked.columns == df.columns
    assert {(r.doc_id, r.text, r.n_chars) for r in masked.collect()} == {(1, None, None), (2, "", 0), (3, "mail <EMAIL> or <EMAIL>", 23)}


def test_mixed_disguises_are_found():
    for span, kind in [
        ("john [at] example dot com", "email"),
        ("john at example[dot]com", "email"),
        ("john at example.com", "email"),
        ("john@example dot com", "email"),
        ("john dot doe (at) mail.example dot com", "email"),
        ("marie (arobase) exemple [point] fr", "email"),
        ("juan [arroba] ejemplo (punto) es", "email"),
        ("plus quatre neuf, trois zéro un deux trois quatre cinq six", "phone"),
        ("+vier neun drei null eins zwei fünf sechs sieben acht", "phone"),
        ("cuatro ocho cuatro cinco uno seis ocho uno uno cuatro cuatro cero siete tres dos nueve", "card"),
        ("one nine two dot one six eight dot zero dot one", "ip"),
        ("192 dot one six eight[dot]0.one", "ip"),
        ("192.168.zero.1", "ip"),
        ("plus 1 four one 5 five five 5 one two three 4", "phone"),
        ("+1 (four one five) 555 1234", "phone"),
        ("4845 1681 one four four zero 7329", "card"),
        ("four, 8, four, 5, one 681, one four four zero 7 three two nine", "card"),
    ]:
        text = f"so {span} or"
        found = [(P.KINDS[k], text[a:b]) for k, a, b, base in P.spans_of(text) if not base]
        assert (kind, span) in found, (text, found)
        assert P.mask(text) == f"so <{kind.upper()}> or"


def test_numbers_beside_a_disguise_do_not_hide_it():
    for text, kind in [("３ was ４８４５ 1681 1440 7329, one of", "card"), ("four eight four five one six eight one one four four zero seven three two nine, 2026", "card"), ("one nine two dot one six eight dot zero dot one 2026", "ip")]:
        assert kind in {P.KINDS[k] for k, *_ in P.spans_of(text)}, text


def test_mixed_disguises_in_clean_text_and_linear_time():
    for text in ["we met at noon. Then", "one dot two dot three", "2019 was one of three", "step 1. 2. 3. four", "one 2 three 4", "@ dot com", " at example.com"]:
        assert P.spans_of(text) == [], text
    for text in ["one " * 50_000, "1 one" * 50_000, "a at b dot " * 20_000, "one dot " * 50_000, "x at a" * 50_000, "1" * 200_000 + "a one"]:
        P.spans_of(text)


DISGUISES = ["one", "nine", "un", "sept", "neuf", "null", "fünf", "cero", "dos", "0", "7", "19", "255", "256", "999", "2026", " ", " ", "-", ".", ",", "(", ")", " dot ", "[dot]", " at ", "(at)", "@", "plus ", "+", "name", "host", "com", "é", "１", "\u200b", "\n", "Ｆ"]


def test_any_mix_of_pieces_gives_sound_spans():
    pick = random.Random(9)
    for _ in range(20_000):
        text = "".join(pick.choice(DISGUISES) for _ in range(pick.randint(1, 24)))
        spans = P.spans_of(text)
        assert [s[:3] for s in spans if s[3]] == P.detect(text), text
        assert all(0 <= a < b <= len(text) for _, a, b, _ in spans), text
        assert P.mask(text) is not None


def test_octets_out_of_range_are_no_address():
    for text in ["1 dot two dot 3 dot 999", "999 dot two dot 3 dot 4", "un dot 2 dot 3 dot 256 7"]:
        assert not [s for s in P.spans_of(text) if s[0] == P.KINDS.index("ip") and "999" in text[s[1] : s[2]]], text
