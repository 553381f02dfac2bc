import hashlib
import random
import re
import time

import pytest
from helpers import documents
from hypothesis import given
from hypothesis import strategies as st

from threadlens.llm import pii
from threadlens.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))]
    return sum(doubled) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def base(text):
    return [s[:3] for s in pii.find(text) if s[3]]


def added(text):
    return [(s[0], text[s[1] : s[2]], s[4]) for s in pii.find(text) if not s[3]]


@given(st.lists(st.sampled_from(["a", "Z", "7", "0", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "+49 30", "(0)", "@", ".", "-", " ", "+", "%", "\n", "é", "@b.c", "５", "​", " at ", " dot ", "one two ", "[at]", "0000000000000"]), max_size=25))
def test_base_spans_equal_the_plain_patterns(parts):
    text = "".join(parts)
    assert base(text) == brute(text)


@given(st.lists(st.sampled_from(["a", "1", "а", "５", "​", "one ", "two-", "triple three ", " [at] ", " dot ", "plus ", "O0O1l", " "]), max_size=20))
def test_offsets_go_back_to_what_was_read(parts):
    text = now = "".join(parts)
    for transducer in pii.TRANSDUCERS:
        stage = transducer(now)
        for k in range(len(stage.text)):
            start, end = stage.source(k, k + 1)
            if stage.touches(k, k + 1):
                assert any((start, end) == e[2:] for e in stage.edits)
            else:
                assert (now[start:end], end) == (stage.text[k], start + 1)
        starts = [stage.source(k, k + 1)[0] for k in range(len(stage.text))]
        assert starts == sorted(starts)
        now = stage.text


@pytest.mark.parametrize(("text", "found"), [
    ("Write to jane [at] example [dot] com today", ("email", "jane [at] example [dot] com", "jane@example.com")),
    ("Write to jane.doe(at)mail.example(dot)org, please", ("email", "jane.doe(at)mail.example(dot)org", "jane.doe@mail.example.org")),
    ("jane at example dot co dot uk is hers", ("email", "jane at example dot co dot uk", "jane@example.co.uk")),
    ("JANE AT EXAMPLE DOT COM", ("email", "JANE AT EXAMPLE DOT COM", "JANE@EXAMPLE.COM")),
    ("Mail: jane @ example.com.", ("email", "jane @ example.com", "jane@example.com")),
    ("an jane {ät} beispiel {punkt} de schreiben", ("email", "jane {ät} beispiel {punkt} de", "jane@beispiel.de")),
    ("jаne@exаmple.com", ("email", "jаne@exаmple.com", "jane@example.com")),
    ("jane＠example．com", ("email", "jane＠example．com", "jane@example.com")),
    ("ja​ne@exa​mple.com", ("email", "ja​ne@exa​mple.com", "jane@example.com")),
    ("host 192[.]168[.]0[.]1 answers", ("ip", "192[.]168[.]0[.]1", "192.168.0.1")),
    ("host 192 dot 168 dot 0 dot 1 answers", ("ip", "192 dot 168 dot 0 dot 1", "192.168.0.1")),
    ("host １９２.１６８.０.１", ("ip", "１９２.１６８.０.１", "192.168.0.1")),
    ("host l92.168.O.1 no, l92.168.00.11", ("ip", "l92.168.00.11", "192.168.00.11")),
    ("card ４１１１ １１１１ １１１１ １１１１ end", ("card", "４１１１ １１１１ １１１１ １１１１", "4111 1111 1111 1111")),
    ("card 4111 1111 1111 1111 end", ("card", "4111 1111 1111 1111", "4111 1111 1111 1111")),
    ("card 4111–1111–1111–1111 end", ("card", "4111–1111–1111–1111", "4111-1111-1111-1111")),
    ("card 4l11 1111 1I11 1111 end", ("card", "4l11 1111 1I11 1111", "4111 1111 1111 1111")),
    ("four one one one one one one one one one one one one one one one", ("card", "four one one one one one one one one one one one one one one one", "4111111111111111")),
    ("call plus four nine three zero one two three four five six seven now", ("phone", "plus four nine three zero one two three four five six seven", "+49301234567")),
    ("call plus 49 30 1234567 now", ("phone", "plus 49 30 1234567", "+49 30 1234567")),
    ("ruf +49 eins zwei drei vier fünf sechs sieben acht an", ("phone", "+49 eins zwei drei vier fünf sechs sieben acht", "+49 12345678")),
    ("call +1 five five five, double zero triple one nine", ("phone", "+1 five five five, double zero triple one nine", "+1 555001119")),
    ("appelle ＋33 ٦١٢٣٤٥٦٧٨ demain", ("phone", "＋33 ٦١٢٣٤٥٦٧٨", "+33 612345678")),
])
def test_disguises_are_found_where_they_stand(text, found):
    assert found in added(text)


@pytest.mark.parametrize("text", [
    "Look at example.com for the dot on the map, at noon or at one or two.", "In 1939–1945 and 2010–2012 the ten of us met at the inn.",
    "Er kam um eins, zwei oder drei Uhr; ein Punkt für uns. Un deux trois, nous irons au bois.", "One two three four five six seven eight nine ten.",
    "Visit us @ noon. I was at 10 l and 100 ml; plus 3 more, 1.2.3 and 300.1.1.1", "Привет, как дела? Ναι, καλά. ½ ² №5 ™", "a [at] b (dot) c", "5l 10l 1O", "",
])
def test_clean_texts_are_left_alone(text):
    found = [s for s in pii.find(text) if not s[3]]
    assert found == ([] if "[at]" not in text else [("email", 0, len(text), False, "a@b.c")])


def test_base_spans_stay_beside_wider_ones():
    text = "jane [dot] doe@example.com, 1.2.3.4"
    assert pii.find(text) == [("email", 0, 26, False, "jane.doe@example.com"), ("email", 11, 26, True, "doe@example.com"), ("ip", 28, 35, True, "1.2.3.4")]


def test_time_is_linear_in_the_text():
    began = time.perf_counter()
    for c in ("a", "1", "@", "a@", "1.", "1 ", "+1", " ", "l", "one ", "​", "[", "at ", "а", "plus ", "1-"):
        pii.find(c * 200_000)
    assert time.perf_counter() - began < 60


def test_odd_rows(spark, edge_rows):
    rows = [(r[0], r[1]) for r in edge_rows] + [(50, "x" * 300_000 + " a@b.c " + "1" * 5_000 + ".1.1.1"), (51, "\U0001f600 1.2.3.4")]
    got = sorted((r.doc_id is not None, r.doc_id, [tuple(s) for s in r.spans]) for r in pii.find_pii(documents(spark, rows)).where("doc_id is not null").collect())
    assert got == sorted((True, i, pii.find(t or "")) for i, t in rows if i is not None)
    assert pii.find_pii(documents(spark, rows)).count() == len(rows)
    assert pii.find_pii(documents(spark, [])).collect() == []
    assert got[-1][2] == [("ip", 2, 9, True, "1.2.3.4")]


def test_query_equals_brute_force(spark, sf_dir):
    got = {r.doc_id: r for r in QUERIES["op13_pii"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) and any(r.n_email for r in got.values())
    for doc_id, text in docs:
        want, r = brute(text or ""), got[doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        listed = [f"{k}:{s}:{e}" for k, s, e in want]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(filter(None, r.spans.split(","))) and r.n_added == len(list(filter(None, r.spans.split(",")))) - len(listed)
