"""The clause grammar against a plain reading of its rules, and page extraction against pages whose article is known."""

import random

import pytest

from sellerlens.llm import html_text, toxicity


# --- the clause grammar ---

def clause_score(symbols):
    """The rules read word by word, without machines."""
    near, words = toxicity.NEAR, list(symbols)

    def rewrite(sign, targets, stops):
        left = 0
        for k, s in enumerate(words):
            if s == sign:
                left = near
            elif left and s in targets:
                words[k], left = targets[s], 0
            elif left:
                left -= 1

    rewrite("M", {"I": "m"}, ())
    rewrite("N", {"I": "i", "K": "k"}, ())
    told = False
    for k, s in enumerate(words):
        told = told or s == "R"
        if told and s in ("I", "i", "K", "k"):
            words[k] = s + "r"
    total, aimed, threat, left = 0.0, False, None, 0
    for s in words:
        if aimed:
            total += toxicity.AIMED.get(s, 0.0)
        elif s == "T":
            aimed = True
            if left:
                total += toxicity.AIMED[threat] - toxicity.BARE[threat]
        else:
            total += toxicity.BARE.get(s, 0.0)
            if s in ("K", "Kr"):
                threat, left = s, near
            else:
                left = max(0, left - 1)
    return total


def test_machine_equals_its_rules():
    machine, rng = toxicity.grammar(), random.Random(2)
    for _ in range(20_000):
        symbols = [rng.choice("IKTNRMooo") for _ in range(rng.randint(0, 9))]
        assert machine.score(symbols) == pytest.approx(clause_score(symbols), abs=1e-9), symbols


def test_clauses_not_words_decide():
    model = toxicity.Model([], (-1.6, 3.4, 3.0))
    scorer = toxicity.Scorer([])
    score = lambda t: model.scores(__import__("numpy").array([scorer.features(t)]))[0]
    toxic = ["idiot", "You are an idiot.", "I will kill you", "you idiot", "I hate you, you stupid loser", "kill them", "You, said he, are scum"]
    clean = ["", None, "The word idiot is a noun", "She said you are not an idiot", "I will not kill you, she said", "The term moron is old", "He said not an idiot", "kill the process", "no loser here"]
    assert [t for t in toxic if score(t) < 0.5] == [] and [t for t in clean if score(t) >= 0.5] == []
    assert score("She said I will kill you") < score("I will kill you")
    assert score("x " * 200_000 + "you idiot") > 0.5


# --- pages ---

def test_pages_without_an_article_element():
    text = lambda n: " ".join(["word"] * n)
    links = "<ul>" + "".join(f"<li><a href=x>link {k}</a></li>" for k in range(6)) + "</ul>"
    cases = [
        (f"<p>{text(45)}</p><p>{text(3)}</p><p>{text(45)}</p>", 93), (f"<h1>{text(2)}</h1><p>{text(45)}</p><p>{text(40)}</p>{links}", 87),
        (f'<div id="top"><p>{text(90)}</p><p>{text(80)}</p></div>', 170), (f'<form id="aspnetForm"><p>{text(90)}</p><p>{text(80)}</p></form>', 170),
        (f'<div class="header-page"><nav>{links}</nav><p>{text(60)}</p></div>', 60), (f'<p title="a>b">{text(50)}</p><p class=it\'s>{text(40)}</p>', 90),
        (f"<p>{text(50)}</p><form><p>{text(12)}</p></form><div id=bottom><p>{text(20)}</p></div>", 50), (f'<p id="5" inch">{text(50)}</p>{links}', 50),
    ]
    for body, n in cases:
        assert len(html_text.main_text(f"<html><body>{body}</body></html>").split()) == n, body[:60]


def test_tree_looks_at_neighbours():
    def features(t):
        return {html_text.FEATURES[t[0]]} | features(t[2]) | features(t[3]) if isinstance(t, tuple) else set()

    assert features(html_text.tree()) & {"words_before", "links_before", "words_after", "links_after"}


@pytest.mark.parametrize("element", ["article", "main", "div"])
def test_random_pages(element):
    """Pages put together from known parts: exactly the article's blocks come back."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    text = lambda low, high: " ".join(word() for _ in range(rng.randint(low, high)))
    link = lambda: f"<a href='/{word()}'>{text(1, 3)}</a>"
    escaped = {"&": "&amp;", "<": "&lt;", "é": "&eacute;", "–": "&#8211;"}
    for _ in range(150):
        blocks, body = [], []
        for k in range(rng.randint(2, 8)):
            t = text(20, 90)
            if rng.random() < 0.5:
                t += f" {rng.choice(list(escaped))} {word()}"
            blocks.append(t)
            shown = "".join(escaped.get(c, c) for c in t)
            if rng.random() < 0.3:
                shown = shown.replace(" ", rng.choice(["\n   ", "&nbsp;", " <b></b>"]), 1)
            body.append(f"<p>{shown}</p>")
            if rng.random() < 0.3:
                body.append(f"<script>var x = '<p>{text(20, 30)}</p>';</script><!-- {text(10, 20)} -->")
            if rng.random() < 0.2:
                body.append(f'<div class="advert">{text(5, 40)}</div>')
        around = [
            f"<nav><ul>{''.join(f'<li>{link()}</li>' for _ in range(rng.randint(2, 9)))}</ul></nav>", f"<header><h1>{text(1, 3)}</h1></header>",
            f"<div id='cookie-notice'>{text(5, 30)}</div>",
        ]
        behind = [
            f"<aside><p>{text(10, 50)}</p></aside>", f"<section class='comments'><p>{text(10, 60)}</p></section>",
            f"<form><p>{text(3, 12)}</p><input></form>", f"<footer>{text(3, 12)}</footer>", f"<ul class=related>{''.join(f'<li>{link()}</li>' for _ in range(4))}</ul>",
        ]
        rng.shuffle(around)
        rng.shuffle(behind)
        page = f"<html><head><title>{word()}</title><style>p{{}}</style></head><body>{''.join(around)}<{element}>{''.join(body)}</{element}>{''.join(behind)}</body></html>"
        assert html_text.main_text(page) == " ".join(blocks)
