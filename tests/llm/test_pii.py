"""Personal data: base spans against a literal reading of their rules, disguises, places, awkward rows."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from siftwright.llm.pii import KINDS, base_spans, find_in, find_pii, masked
from siftwright.llm.registry import op11_pii


def _luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 else 1)
        total += d // 10 + d % 10
    return total % 10 == 0


def _plainly(text):
    """The rules as they are written, each by its own pattern."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def test_base_spans_are_those_of_the_rules():
    r = random.Random(4)
    for alphabet in ("a1.@-+ ", "0123456789.-+ ()", "ab@.é%_", "0.1", "12 -", "@.a", "+1(2) "):
        for _ in range(4000):
            text = "".join(r.choice(alphabet) for _ in range(r.randrange(40)))
            assert base_spans(text) == _plainly(text), text
    for _ in range(3000):
        number = "".join(str(r.randrange(10)) for _ in range(r.randrange(10, 21)))
        text = f"x {number[:4]} {number[4:8]}-{number[8:]} +1 ({number[:3]}) 555-{number[3:7]} {number}.1.2.3 a@b.{number}.c"
        assert base_spans(text) == _plainly(text), text


@pytest.mark.parametrize(
    "text, kind, held",
    [
        ("write to jane (at) example (dot) com now", "email", "jane (at) example (dot) com"),
        ("write to jane.roe[at]example[dot]org.", "email", "jane.roe[at]example[dot]org"),
        ("so ask jane dot roe at mail dot example dot com for it", "email", "jane dot roe at mail dot example dot com"),
        ("JANE AT EXAMPLE DOT COM", "email", "JANE AT EXAMPLE DOT COM"),
        ("jane @ example.com", "email", "jane @ example.com"),
        ("jane@example dot com", "email", "jane@example dot com"),
        ("a jаne@exаmple.com b", "email", "jаne@exаmple.com"),  # two Cyrillic letters
        ("jane＠example．com", "email", "jane＠example．com"),
        ("ja​ne@exam​ple.com", "email", "ja​ne@exam​ple.com"),
        ("jane_at_example_dot_net", "email", "jane_at_example_dot_net"),
        ("ana arroba correo punto es, sí", "email", "ana arroba correo punto es"),
        ("by bosbt.42 at mail8.example.com now", "email", "bosbt.42 at mail8.example.com"),
        ("by bosbt.42 @ mail8 . example . com now", "email", "bosbt.42 @ mail8 . example . com"),
        ("by bosbt&#46;42&#64;mail8&period;example.com now", "email", "bosbt&#46;42&#64;mail8&period;example.com"),
        ("by bosbt[.]42[@]mail8[.]example[.]com now", "email", "bosbt[.]42[@]mail8[.]example[.]com"),
        ("𝟒𝟎𝟒𝟏 𝟖𝟗𝟒𝟗 𝟕𝟒𝟔𝟎 𝟖𝟕𝟗𝟓", "card", "𝟒𝟎𝟒𝟏 𝟖𝟗𝟒𝟗 𝟕𝟒𝟔𝟎 𝟖𝟕𝟗𝟓"),
        ("call +1 (3I9) 555-5l3o now", "phone", "+1 (3I9) 555-5l3o"),
        ("host 192[.]168[.]1[.]20 is up", "ip", "192[.]168[.]1[.]20"),
        ("host 192 dot 168 dot 1 dot 20 is up", "ip", "192 dot 168 dot 1 dot 20"),
        ("one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("host l92.168.O.1 is up", "ip", "l92.168.O.1"),
        ("card four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
        ("card 4111 1111 one one one one 1111 ok", "card", "4111 1111 one one one one 1111"),
        ("card ４１１１ １１１１ １１１１ １１１１ ok", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("card 4lll 1111 1111 1111 ok", "card", "4lll 1111 1111 1111"),
        ("call plus one two zero two five five five zero one two three now", "phone", "plus one two zero two five five five zero one two three"),
        ("call +1 (two zero two) five five five - zero one two three now", "phone", "+1 (two zero two) five five five - zero one two three"),
        ("call +1 202 555 double zero 99 now", "phone", "+1 202 555 double zero 99"),
        ("ruf plus vier neun drei null eins zwei drei vier fünf sechs an", "phone", "plus vier neun drei null eins zwei drei vier fünf sechs"),
    ],
)
def test_disguises_are_found_where_they_stand(text, kind, held):
    found = [(k, text[a:b]) for k, a, b, base in find_in(text) if not base]
    assert (kind, held) in found
    for before in ("", "é ß \U0001f600 ", "x at y. "):  # places are code points, whatever stands before
        moved = [(k, (before + text)[a:b]) for k, a, b, base in find_in(before + text) if not base]
        assert (kind, held) in moved


@pytest.mark.parametrize(
    "text",
    [
        "look at the dot com bubble, at once",
        "meet me at example.com at noon, at 10 or one of 2 at 3, 42 at example.com",
        "10l of water at 20o . com, room 101l, x . y . z, at . com",
        "call +1 202 555 0123 one day",
        "one 4111 1111 1111 1111 two three",
        "un deux trois, sept ou huit points; a point at most",
        "dos o tres, 555 o 556, at (a) or [1.] and f(x)",
        "mail bosbt.42@mail8.example.com or 42.144.35.254, card 4041894974608795",
        "Es ist null und nichtig, eins zwei drei vier fünf",
        "version 1.2.3, page 10-12, 2019-2020, x@y and @z",
    ],
)
def test_clean_texts_get_no_spans_added(text):
    assert [(k, a, b) for k, a, b, _ in find_in(text)] == _plainly(text)


def test_long_texts_take_time_in_proportion():
    long = 300_000
    for piece in ("a", "1", "1.", "@", "a@", "+1 ", "(", " ", "one ", "1 one ", "dot ", "a dot ", "at ", "a1 at ", "a.b ", " . ", "%40", "l1", "４", "​", "a.", "_at_", "[dot", "+1(", "point ", "plus "):
        text = piece * (long // len(piece))
        began = time.time()
        find_in(text)
        find_in(text + "é")
        assert time.time() - began < 20, piece


def test_rows_of_all_kinds(spark):
    rows = [(1, "a@b.co"), (1, "a@b.co"), (2, None), (3, ""), (None, "jane (at) x (dot) io"), (4, "x " * 200_000 + "+1 (202) 555-0123")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = docs.select("*", *(F.lit(f"own {n}").alias(n) for n in ("__text", "pii", "kind", "start", "end", "base", "n_email")))
    got = find_pii(clashing).collect()
    assert len(got) == 6 and all(r["__text"] == "own __text" and r["kind"] == "own kind" for r in got)
    found = {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.pii] for r in got}
    assert found == {1: [("email", 0, 6, True)], 2: [], 3: [], None: [("email", 0, 20, False)], 4: [("phone", 400_000, 400_017, True)]}
    assert find_pii(docs.limit(0)).count() == 0
    hidden = find_pii(spark.createDataFrame([("to a@b.co, 1.2.3.4 x (at) y (dot) de.",)], "text string"), keep=["text"]).select(masked(F.col("text"), F.col("pii"))).first()[0]
    assert hidden == "to [EMAIL], [IP] [EMAIL]."


def test_query_against_the_rules(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.01"
    texts = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = {}
    for t in texts:
        spans = _plainly(t["text"] or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want[t["doc_id"]] = (*(sum(s[0] == k for s in spans) for k in KINDS), hashlib.sha256(listed.encode()).hexdigest(), set(listed.split(",")) - {""})
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, set(r.spans.split(",")) - {""}) for r in op11_pii(spark, sf).collect()}
    assert {d: v[:5] for d, v in got.items()} == {d: v[:5] for d, v in want.items()}
    assert all(want[d][5] <= v[5] for d, v in got.items())
    assert sum(v[0] + v[1] + v[2] + v[3] for v in got.values()) > 50
