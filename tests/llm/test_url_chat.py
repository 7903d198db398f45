import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm import chat, urlfilter
from riskweave.llm.queries import URL_RULES

EMPTY_PAGES = "page_id bigint, url string, html string, host string, rule int"


def test_url_parts():
    for url, want in {None: ("", ""), "": ("", ""), "a.com/x": ("", ""), "http://A.Com": ("a.com", ""), "x://É.COM/P?q#f": ("É.com", "/P"),
                      "http://h?x/y": ("h", ""), "http://h#/y": ("h", ""), "a://b://c/d": ("b:", "//c/d"), "://h/p": ("h", "/p")}.items():
        assert urlfilter.parts(url) == want


def test_rules():
    judge = urlfilter.Judge(urlfilter.Filter(URL_RULES))
    for url, want in {"http://a.example.org/es/1": ("example.org/es/", "block"), "http://example.org/en/1": ("example.org/en/1", "block"),
                      "http://x.org/en/1": ("org/", "allow"), "http://org/": ("org/", "allow"), "http://notorg/": None, "http://x.org": None,
                      "http://b.com/fr/spam": ("com/fr/", "allow"), "http://com/de/": ("com/de/", "block"), "http://xcom/de/": None,
                      "http://badexample.org/es/": ("org/", "allow")}.items():
        assert judge.rule(*urlfilter.parts(url)) == want
        assert want is None or judge.judge(url)[3] == want[1]


def test_vocabulary_against_plain_search():
    judge = urlfilter.Judge(urlfilter.Filter([]))
    for url in ["http://casino.net/", "http://mycasino.net/", "http://cheap-pills.net", "http://cheap-cheap.net/cheap", "http://FREE.net/x_bets", "http://a.net/win9",
                "http://spam-farm.net", "adult", "http://a.net/ads?track=1", "http://essex.net/sex"]:
        low = url.lower()
        found = {t for t in judge.weights for k in range(len(low))
                 if low.startswith(t, k) and not low[k - 1:k].isalnum() and not low[k + len(t):k + len(t) + 1].isalnum()}
        assert judge.hits(url) == found
        strict, soft = len(found & set(urlfilter.STRICT_TERMS)), len(found & set(urlfilter.SOFT_TERMS))
        assert judge.judge(url)[3:] == ("block" if strict or soft >= 2 else "allow", strict, soft)


def test_url_hard_rows(spark):
    rows = [(1, None, None, "h", 1), (None, "http://x.org/a", "", "h", 1), (2, "http://" + "a." * 5000 + "org/" + "x" * 50_000, "", "h", 1),
            (3, "http://casino.net", "", "h", 1), (3, "http://casino.net", "", "h", 1)]
    got = urlfilter.judge(spark.createDataFrame(rows, EMPTY_PAGES), urlfilter.Filter(URL_RULES)).collect()
    assert [r["verdict"] for r in got] == ["allow", "allow", "allow", "block", "block"] and got[0]["host"] == "" and got[2]["rule"] == "org/"
    assert urlfilter.judge(spark.createDataFrame([], EMPTY_PAGES), urlfilter.Filter(URL_RULES)).count() == 0
    assert urlfilter.Judge(urlfilter.Filter([], {})).judge("http://casino.net")[3] == "allow"


PIECES = ["[INST]", "[/INST]", " [/INST]", "</s>", " </s>", "<s>", "<<SYS>>\n", "\n<</SYS>>\n", "[ROLE ", "[/ROLE]", "]", "\\", " ", "\n", "a", "é"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)
ROLE = st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), TEXT)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=5))
def test_round_trip(turns):
    rendered = [chat.render(r, t) for r, t in turns]
    assert chat.parse_all("".join(r[0] for r in rendered)) == turns
    for (role, text), (formatted, _, _, start, end) in zip(turns, rendered):
        assert chat.unescape(formatted[start:end]) == text


def test_plain_texts_are_not_escaped():
    assert chat.render("user", "a [b] <c>")[0] == "[INST] a [b] <c> [/INST]"


def test_conversations(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, formatted string, loss_start string"
    rows = [(1, 1, "assistant", "b </s> c"), (1, 0, "user", "a"), (2, 0, "user", None), (2, None, None, "x"), (None, 0, "assistant", ""),
            (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 0, "assistant", "y" * 300_000), (1, 2, "tool]", "\\z")]
    turns = chat.format_turns(spark.createDataFrame([(*r, "f", "s") for r in rows], schema))
    got = {r["conv_id"]: r for r in chat.digest_conversations(turns).collect()}
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for conv, g in groups.items():
        g.sort()
        loss = "".join(t for *_, role, t in g if role == "assistant")
        assert got[conv]["n_turns"] == len(g)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in g).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["formatted_chars"] == sum(len(chat.render(r, t)[0]) for *_, r, t in g)
    assert chat.digest_conversations(chat.format_turns(spark.createDataFrame([], schema))).count() == 0
