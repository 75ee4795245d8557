import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import pairs as p

FIG = "\\begin{tikzpicture}\n\\draw (A) -- (B);\n\\end{tikzpicture}"
PROMPT = "Let M be the midpoint of A and B. Draw a circle of radius 4 about M. The heights of ABC run together in H. Mirror H in the line AB to get K."
OTHER = "Die Geraden AB und CD schneiden sich im Punkt H. Um M liegt ein Kreis mit dem Radius 4."


@pytest.mark.parametrize(
    "text,defect",
    [
        (None, "empty"), ("", "empty"), ("```latex\n\n```", "empty"), ("\\begin{tikzpicture}\n\\end{tikzpicture}", "empty"), ("%\n%", "empty"), ("\u2060 \ufeff", "empty"), (FIG, None), (f"```\n{FIG}\n```", None),
        ("I’m sorry, but I can’t assist with that.", "refusal"), ("Leider kann ich diese Zeichnung nicht erstellen.", "refusal"), (f"I cannot round M without error, so I am unable to be exact.\n{FIG}", None),
        ("CLARIFY: I am unable to see M, which one is it?", None), (PROMPT, "copy"), ("> " + PROMPT.upper(), "copy"), (". ".join(reversed(PROMPT.split(". "))), "copy"), (f"{PROMPT}\n{FIG}", None),
        (OTHER, "language"), (f"{OTHER}\n{FIG}", "language"), (FIG.replace("\\draw", "% Der Punkt halbiert die Strecke und wird dann zu M.\n\\draw"), "language"), (f"The circle is here.\n{FIG}", None),
        (f"以M为圆心作半径为4的圆。\n{FIG}", "language"), (FIG.replace("\\draw", "% umber gable 42\n\\draw"), None),
    ],
)
def test_defects(text, defect):
    assert p.Judge().defect(PROMPT, text, False) == defect


@pytest.mark.parametrize(
    "text,refuses",
    [
        ("I won't be generating this picture.", True), ("We are not able to do so.", True), ("I'd rather not answer.", True), ("My guidelines keep me from it.", True), ("No figure will be provided.", True), ("This is not something I can do.", True),
        ("Je ne peux pas tracer cela.", True), ("No la puedo dibujar.", True), ("Ich darf das leider nicht.", True), ("Я не могу.", True), ("Niestety nie.", True), ("我无法画这个图。", True), ("Non posso farlo.", True), ("Dat kan ik niet tekenen.", True),
        ("The points cannot lie on the circle, so the line is unable to meet it.", False), ("Hawaii must decline in area here.", False), ("I cannot round M, so the exact value is used.", False), ("Ein Kreis ist nicht hier.", False), ("The rules are kept.", False),
    ],
)
def test_refusals_need_a_speaker_and_a_task(text, refuses):
    assert p.Judge().refuses(text) is refuses


@pytest.mark.parametrize("inside,defect", [("% I can't help with drawing this.", "refusal"), ("% " + PROMPT, "copy"), ("% grey kite 12", None), ("\\draw (A) -- (B); % I can't help with drawing this.", None)])
def test_a_figure_of_comments_draws_nothing(inside, defect):
    assert p.Judge().defect(PROMPT, f"\\begin{{tikzpicture}}\n{inside}\n\\end{{tikzpicture}}", False) == defect


def test_order_of_defects():
    j = p.Judge()
    assert j.defect(PROMPT, "", True) == "empty" and j.defect(PROMPT, "I can't assist", True) == "truncated"
    assert j.defect("two words", "two words", False) == "copy"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14), st.integers(1, 4))
def test_suffix_automaton_covers_common_runs(own, mine, run):
    share, _ = p.SuffixAutomaton(own).coverage(mine, len(own), run)
    runs = {tuple(own[i : i + run]) for i in range(len(own) - run + 1)}
    covered = set()
    for i in range(len(mine) - run + 1):
        if tuple(mine[i : i + run]) in runs:
            covered |= set(range(i, i + run))
    assert share == pytest.approx(len(covered) / max(1, len(mine)))


def test_languages():
    assert p.language(PROMPT) == "en" and p.language(OTHER) == "de" and p.language("A B C 12") is None
    assert p.language("Соединим A и B пунктирной линией из точки на прямой.") == "ru" and p.language("点M是线段AB的中点。") == "zh"
    assert p.language("Il punto è nel mezzo della retta che passa per A e per B, e poi si disegna il cerchio.") == "it" and p.language("De lijn van het punt naar de cirkel is niet met een boog.") == "nl"
    assert p.language("これは点です。") == "ja" and p.language("O ponto não está na reta que passa pelo meio da figura, e depois...") == "pt" and p.language("") is None


def test_table(spark):
    prompts = spark.createDataFrame([(1, PROMPT, "n"), (1, PROMPT, "n"), (2, "  ", "n"), (3, None, "n")], "illus_id long, description string, text string")
    rows = [(10, 1, None), (11, 1, "It breaks off"), (11, 1, "It breaks off"), (12, 2, ""), (13, 3, ""), (14, 9, ""), (15, None, ""), (16, 1, PROMPT), (17, 1, FIG)]
    answers = spark.createDataFrame(rows, "gen_id long, illus_id long, text string")
    cut = spark.createDataFrame([(11,), (11,), (10,)], "gen_id long")
    got = {tuple(r) for r in p.defective_pairs(prompts, "illus_id", "description", answers, "gen_id", "text", cut).collect()}
    assert got == {(10, "empty"), (11, "truncated"), (16, "copy")}
    assert p.defective_pairs(prompts.limit(0), "illus_id", "description", answers.limit(0), "gen_id", "text", cut.limit(0)).collect() == []
    rng = random.Random(1)
    long = " ".join(rng.choice("abcdefgh") for _ in range(20_000))
    assert p.Judge().copies(long, long)
