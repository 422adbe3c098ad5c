import numpy as np
import pytest

from skein.llm import pairs, refusals
from tests.llm.test_languages import TEXTS

SUBJECT = {"en": ["The backup", "The server", "The disk", "The agent"], "de": ["Die Sicherung", "Der Server", "Die Platte", "Der Agent"], "fr": ["La sauvegarde", "Le serveur", "Le disque", "L'agent"]}
VERB = {"en": ["stopped after the update.", "needs more free space.", "was moved to another host.", "skips all changed files."], "de": ["brach nach der Aktualisierung ab.", "benötigt mehr freien Speicher.", "wurde auf einen anderen Rechner verlegt.", "überspringt alle geänderten Dateien."], "fr": ["s'est arrêtée après la mise à jour.", "exige plus d'espace libre.", "a été déplacé vers un autre hôte.", "ignore tous les fichiers modifiés."]}
ASK = {"en": "Why does the job VM-SNAP end with an error on host {}?", "de": "Warum endet der Auftrag VM-SNAP auf dem Rechner {} mit einem Fehler?", "fr": "Pourquoi la tâche VM-SNAP se termine-t-elle avec une erreur sur {} ?"}


def sound(rng, lang):
    said = " ".join(f"{rng.choice(SUBJECT[lang])} {rng.choice(VERB[lang])}" for _ in range(int(rng.integers(2, 5))))
    return ASK[lang].format(f"h{rng.integers(100)}"), said


@pytest.fixture(scope="module")
def judge(spark):
    rng = np.random.default_rng(1)
    real = [sound(rng, lang) for lang in ("en", "de", "fr") for _ in range(60)]
    text = [(" ".join(a for q, a in real[k * 60 : k * 60 + 60]) + " " + TEXTS[lang] + " " + ASK[lang], lang) for k, lang in enumerate(("en", "de", "fr"))] + [(t, lang) for lang, t in TEXTS.items()]
    from skein.llm import languages

    return pairs.fit(real, languages.train(spark.createDataFrame(text, "text string, lang string")))


def test_defects(spark, judge):
    rng = np.random.default_rng(9)
    q, a = sound(rng, "en")
    foreign = sound(rng, "de")[1]
    rows = [
        (1, q, a, None), (2, q, None, "empty"), (3, q, " ", "empty"), (4, q, "<p></p>", "empty"), (5, q, "N/A", "empty"), (6, q, q, "copy"), (7, q, f'"{q.upper()}"', "copy"), (8, q, foreign, "other_language"), (9, q + " Please answer in German.", foreign, None),
        (10, q, "I'm sorry, but I can't help with that.", "refusal"), (11, q, "I'm sorry for the trouble this caused. " + a, None), (12, q, a[:-12], "truncated"), (13, q, a + "\n1. " + a + "\n2.", "truncated"), (14, q, a + "\n```\n$ ls", "truncated"), (15, q, f"You asked: {q}\n{a}", None),
        (16, q, "restart --all", None), (17, None, a, None),
    ]
    df = spark.createDataFrame([(k, x, y, "old") for k, x, y, _ in rows], "k int, question string, answer string, defect string")
    got = {r["k"]: r["defect"] for r in pairs.flag_defects(df, judge).collect()}
    wrong = {k: (got[k], want) for k, _, _, want in rows if got[k] != want}
    assert len(wrong) <= 1, wrong


def test_pairing(spark, monkeypatch):
    rows = [
        (1, 1, 0, "HUMAN", "q0"), (2, 1, 1, "AI", "a1"), (3, 1, 1, "AI", "a1"), (4, 1, 2, "SystemMessage", "s"), (5, 1, 3, "assistant", "a3"), (6, 2, 0, "ai", "alone"), (7, 3, 0, "user", None), (8, 3, 9, " AIMessage", None), (9, None, 1, "ai", "x"), (10, 4, 0, None, "x"),
    ]
    df = spark.createDataFrame(rows, "message_id int, conv_id long, turn int, type string, content string")
    want = {(1, 1, "q0", "a1"), (1, 3, "q0", "a3"), (3, 9, None, None)}
    assert {tuple(r) for r in pairs.paired(df).collect()} == want
    monkeypatch.setattr(pairs, "TURN_BLOCK", 2)
    assert {tuple(r) for r in pairs.paired(df).collect()} == want
    assert pairs.paired(df.limit(0)).count() == 0


def test_held_out_pairs_made_the_same_way(judge):
    rng = np.random.default_rng(77)
    f = pairs._features(judge)
    right = total = 0
    for k in range(60):
        lang = ("en", "de", "fr")[k % 3]
        q, a = sound(rng, lang)
        others = [(c, sound(rng, c)[1]) for c in ("en", "de", "fr") if c != lang]
        for question, answer, kind in pairs._spoil(rng, q, a, others, lang, ["status --all", "mount -a"]):
            right += judge.defect(f, question, answer) == (pairs.DEFECTS[kind] if kind >= 0 else None)
            total += 1
    assert right / total > 0.93


def test_refusals_of_families_that_were_held_out(judge, monkeypatch):
    """The refusal model recognises refusals made by rules that it was not fitted with."""
    monkeypatch.setattr(pairs, "MADE_REFUSALS", 200)
    rng = np.random.default_rng(3)
    real = [sound(rng, lang) for lang in ("en", "de", "fr") for _ in range(60)]
    caught = {}
    for family in refusals.FAMILIES:
        rest = tuple(x for x in refusals.FAMILIES if x != family)
        f = pairs.Features(judge.speech)
        f.refusal, f.excuse = pairs.fit_refusals(real, f.chunks, np.random.default_rng(4), rest)
        for lang in ("en", "de", "fr"):
            said = [refusals.draw(rng, lang, "VM-SNAP", (family,)) for _ in range(80)]
            caught[family, lang] = np.mean([r >= 0.5 for r, _ in f.refused(said)])
    assert np.mean(list(caught.values())) > 0.6, caught
    f = pairs._features(judge)
    near = [refusals.draw_near(rng, lang, "VM-SNAP") for lang in ("en", "de", "fr") for _ in range(80)]
    assert np.mean([r >= 0.5 for r, _ in f.refused(near)]) < 0.05


def test_a_batch_gives_what_single_pairs_give(judge):
    rng = np.random.default_rng(12)
    rows = [sound(rng, lang) for lang in ("en", "de", "fr") for _ in range(10)] + [("", None), ("x", ""), ("q" * 50_000, "a " * 100_000), ("서버가 왜 멈췄나요?", "서버를 다시 시작하세요."), ("x", "죄송하지만 이 질문에는 답할 수 없습니다.")]
    f = pairs._features(judge)
    assert judge.defects(f, [q for q, _ in rows], [a for _, a in rows]) == [judge.defect(pairs.Features(judge.speech, judge.refusal, judge.excuse), q, a) for q, a in rows]


def test_sample_is_bounded_and_pairs_only_chosen_conversations(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SAMPLE_PAIRS", 7)
    df = spark.range(200).selectExpr("id as message_id", "id div 4 as conv_id", "cast(id % 4 as int) as turn", "if(id % 2 = 0, 'human', 'ai') as type", "concat('text ', id) as content")
    found = pairs.sample_pairs(df)
    assert len(found) == 7 and found == pairs.sample_pairs(df.repartition(5))
    assert all(int(a.split()[1]) == int(q.split()[1]) + 1 for q, a in found)
    assert pairs.sample_pairs(df.limit(0)) == []
