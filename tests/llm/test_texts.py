"""Host rules, personal data, licence statements and page texts, each held against a plain version or planted cases."""

import random
import re
import zlib

import pytest

from cutlake.llm import host_rules, html_text, licences, pii

WS = " \t\n\r\x0b\x0c"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- host rules


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, seen, dups = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(covered)


def test_measures_agree_with_a_plain_count():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab#é \n\t\x0b 😀") for _ in range(rng.randint(0, 120)))
        assert host_rules.measure(text) == plain_measures(text)
    assert host_rules.measure(None) == host_rules.measure("") == (0, 0, 0, 0, 0)


def take_rows():
    clean = " ".join(f"word{i}" for i in range(80))
    rows = [(i, "good", clean + f" {i}", "x") for i in range(40)]
    rows += [(100 + i, "bad", "too short", "x") for i in range(40)] + [(150, "bad", clean, "x")]
    rows += [(200, "small", "too short", "x"), (201, "small", clean, "x"), (None, None, None, None), (300, None, "", "x"), (300, None, "", "x")]
    return rows


def test_hosts_with_many_failures_take_their_takes_with_them(spark):
    takes = frame(spark, take_rows(), "take_id bigint, source_name string, text string, kept string")
    out = {(r.take_id, r.source_name): r for r in host_rules.judge_takes(takes).collect()}
    assert all(out[i, "good"].kept for i in range(40))
    assert not out[150, "bad"].kept and not out[150, "bad"].base_failed
    assert out[201, "small"].kept and not out[200, "small"].kept
    assert not out[None, None].kept and out[None, None].n_words == 0
    assert host_rules.judge_takes(takes).where("take_id = 300").count() == 2
    assert 0.75 < out[150, "bad"].host_rate <= 40 / 41
    assert host_rules.judge_takes(takes.limit(0)).count() == 0


# ------------------------------------------------------------- personal data


def plain_pii(text):
    """The base formats, said as plain regular expressions."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m[0])
        if 13 <= len(digits) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_plain_spans_are_those_of_the_formats():
    rng = random.Random(5)
    atoms = ["a", "b.c", "@", ".", "-", "_", "+", "4111111111111111", "10", "255", "256", " ", "x@y.de", "1.2.3.4", "+49 30 123456", "é", "(", ")", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(atoms) for _ in range(rng.randint(0, 14)))
        found = pii.plain_spans(text)
        assert [(k, *s) for k in pii.KINDS for s in found[k]] == plain_pii(text), text


@pytest.mark.parametrize(
    "text, kind, covered",
    [
        ("write to jane (at) mail [dot] example.com today", "email", "jane (at) mail [dot] example.com"),
        ("write to jane at example dot com today", "email", "jane at example dot com"),
        ("write to jаne@exаmple.com today", "email", "jаne@exаmple.com"),
        ("mail ja​ne＠example．com now", "email", "ja​ne＠example．com"),
        ("call plus four nine three zero one two three four five six seven please", "phone", "plus four nine three zero one two three four five six seven"),
        ("card four one one one 1 1 1 1 1 1 1 1 one one one one end", "card", "four one one one 1 1 1 1 1 1 1 1 one one one one"),
        ("host one nine two dot one six eight dot one dot two zero end", "ip", "one nine two dot one six eight dot one dot two zero"),
        ("host １９２.168.1.20 end", "ip", "１９２.168.1.20"),
        ("jane&#64;example.com", "email", "jane&#64;example.com"),
    ],
)
def test_hidden_identifiers_are_found_at_their_source(text, kind, covered):
    plain, hidden = pii.find_spans(text)
    assert [(k, text[s:e]) for k in pii.KINDS for s, e in hidden[k]] == [(kind, covered)]
    assert not any(s == pii.find_spans(text)[1][kind][0] for s in plain[kind])


@pytest.mark.parametrize(
    "text, kind, covered",
    [
        ("host 192 dot 168 dot 0 dot 1 end", "ip", "192 dot 168 dot 0 dot 1"),
        ("host 10 192 dot 168 dot oh dot 1 end", "ip", "192 dot 168 dot oh dot 1"),
        ("host one dot two dot three dot four end", "ip", "one dot two dot three dot four"),
        ("write to jane at example.com today", "email", "jane at example.com"),
        ("write to jane at mail.example dot org today", "email", "jane at mail.example dot org"),
        ("call plus one five five five eight six seven 5309 now", "phone", "plus one five five five eight six seven 5309"),
        ("call plus one five oh five eight six seven 5309 now", "phone", "plus one five oh five eight six seven 5309"),
    ],
)
def test_plain_disguises_are_found_by_themselves(text, kind, covered):
    _, hidden = pii.find_spans(text)
    assert [(k, text[s:e]) for k in pii.KINDS for s, e in hidden[k]] == [(kind, covered)]


def test_sentences_with_figures_are_left_alone():
    for text in ["one two three four five", "oh one day. 2 dot 5 points", "we looked at noon.Then left", "at 10.30 on 4 5 2020 dot", "oh oh oh oh oh dot oh"]:
        assert not any(pii.find_spans(text)[1].values()), text


def test_clean_text_has_no_hidden_identifiers():
    for text in ["look at the dot on the wall", "one two three", "we met at noon. dot com boom", "at 10.30 (at) home", "", "zero one two three four five six seven", "naïve – “quoted” text"]:
        assert not any(pii.find_spans(text)[1].values()), text


def test_long_runs_stay_linear():
    for text in ["a" * 300_000 + "@", "1" * 200_000, "1." * 100_000, "+1" * 100_000, "one " * 50_000, "[at]" * 50_000, "a at " * 50_000, "а" * 100_000, "9 " * 100_000]:
        pii.find_spans(text)


def test_spans_table_and_masks(spark):
    from pyspark.sql import functions as F

    rows = [(1, "a@b.de and +49 30 1234567", "s"), (None, None, None), (2, "", "s"), (2, "", "s")]
    takes = frame(spark, rows, "take_id bigint, text string, spans string")
    out = pii.personal_spans(takes).collect()
    assert sorted(len(r.spans) for r in out) == [0, 0, 0, 2]
    masked = [r[0] for r in takes.select(pii.masked_text("text").alias("m")).collect()]
    assert masked == ["<EMAIL> and <PHONE>", None, "", ""]
    assert pii.personal_spans(takes.where(F.lit(False))).count() == 0


# ---------------------------------------------------------------- licences


def test_licences_are_confirmed_by_wording(spark):
    full = licences.TEMPLATES[0][1]
    rows = [
        (1, "Some scene.\nReleased under the MIT License.\nAnother scene."),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "This work is licensed under the GNU General Public License, version 2."),
        (4, "A licence was granted to film the bridge, with permission of the city."),
        (5, full.replace("merge, ", "").upper() + "\nAll rights reserved."),
        (None, None), (6, ""), (7, "Licensed under CC BY-NC 4.0."), (7, "Licensed under CC BY-NC 4.0."),
    ]
    out = licences.licence_statements(frame(spark, rows, "take_id bigint, text string")).collect()
    got = sorted((r.take_id, r.licence, r.n_differing) for r in out)
    assert got == [(1, "MIT", 0), (2, "GPL-3.0", 0), (3, "GPL-2.0", 0), (5, "MIT", 1), (5, "reserved", 0), (7, "CC-BY-NC-4.0", 0), (7, "CC-BY-NC-4.0", 0)]
    texts = dict(r for r in rows if r[0])
    assert all(texts[r.take_id][r.start : r.end].split()[0].lower() in ("released", "this", "permission", "all", "licensed") for r in out)


def test_approximate_matching_is_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        own = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        best = {}
        row = list(range(len(own) + 1))
        for j, w in enumerate(words, 1):
            new = [0]
            for i, o in enumerate(own, 1):
                new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (o != w)))
            row = new
            best[j] = row[-1]
        assert licences._ends(own, words, len(own)) == [(j, d) for j, d in best.items() if d <= len(own)]


# ------------------------------------------------------------------- pages

PAGE = (
    "<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li>menu<li>two</ul></nav>"
    "<header>top</header><div class='cookie-notice'>cookies</div><article><header><h1>Title {n} &amp; more</h1></header><p><b>First   part<br>second<p>Third &lt;b&gt; "
    "<div class=\"ad\">buy</div><div class='box'>Follow us everywhere</div><ul><li>one {n}<li>two</ul><form>name</form><section id='comments'><p>great!</section></article>"
    "<aside>side</aside><footer>foot</footer></body>"
)


def test_pages_lose_furniture_and_templates(spark):
    rows = [(i, f"https://www.site.org/{i}", PAGE.format(n=i)) for i in range(12)]
    rows += [(90, "https://other.org/", PAGE.format(n=90)), (91, None, None), (92, "", ""), (92, "", "")]
    pages = frame(spark, rows, "page_id bigint, url string, html string").selectExpr("*", "'x' as text", "1 as host")
    out = {r.page_id: r for r in html_text.page_texts(pages).collect()}
    assert out[3].text == "Title 3 & more First part second Third <b> one 3 two"
    assert out[90].text == "Title 90 & more First part second Third <b> Follow us everywhere one 90 two"  # one page makes no template
    assert out[91].text == out[92].text == "" and out[3].n_chars == len(out[3].text) and out[3].host == 1
    assert html_text.page_texts(pages.limit(0)).count() == 0


def test_copies_of_a_page_and_repeated_paragraphs_are_text(spark):
    copies = [(i, "http://h/x", "<article><p>Same paragraph.</p><div>Same block</div></article>") for i in range(20)]
    shared = [(100 + i, "http://k/x", f"<article><p>Shared paragraph.</p><p>Own {i}</p></article>") for i in range(20)]
    out = html_text.page_texts(frame(spark, copies + shared, "page_id bigint, url string, html string")).collect()
    assert {r.text for r in out if r.page_id < 100} == {"Same paragraph. Same block"}
    assert all(r.text == f"Shared paragraph. Own {r.page_id - 100}" for r in out if r.page_id >= 100)


def test_deep_and_broken_pages():
    assert html_text.main_text("<div>" * 20_000 + "x") == "x"
    assert html_text.main_text("<b>" * 20_000 + "</i>" * 20_000 + "y") == "y"
    assert html_text.main_text("a < b &amp b <p") == html_text.main_text("a < b &amp b <p")
    assert zlib.crc32(html_text.main_text("<table><tr><td>1<td>2<tr><td>3</table>").encode()) == zlib.crc32(b"1 2 3")
