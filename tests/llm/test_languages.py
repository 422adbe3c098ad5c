import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import languages

TEXTS = {
    "en": "The backup job stopped because the disk was full. Please check the log file before you start it again. Nobody has changed the settings since last week.",
    "de": "Die Sicherung wurde abgebrochen, weil die Platte voll war. Bitte prüfen Sie das Protokoll, bevor Sie sie wieder starten. Niemand hat seit letzter Woche etwas geändert.",
    "fr": "La sauvegarde s'est arrêtée parce que le disque était plein. Vérifiez le journal avant de la relancer. Personne n'a changé les réglages depuis la semaine dernière.",
    "es": "La copia se detuvo porque el disco estaba lleno. Revise el registro antes de volver a empezar. Nadie ha cambiado los ajustes desde la semana pasada.",
    "pt": "A cópia parou porque o disco estava cheio. Verifique o registro antes de começar de novo. Ninguém mudou as configurações desde a semana passada.",
    "ko": "디스크가 가득 차서 백업이 중단되었습니다. 다시 시작하기 전에 로그를 확인하십시오.",
    "ja": "ディスクがいっぱいになったためバックアップは停止しました。再開する前にログを確認してください。",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(f"{t} {k}", lang) for lang, t in TEXTS.items() for k in range(4)] + [(TEXTS["de"], "en"), (None, "en"), ("", "fr"), ("x", None)]
    return languages.train(spark.createDataFrame(rows, "text string, lang string"))


def test_cases(spark, model):
    log = "2024-07-25 08:25:42 [INFO] vkjobd(9412): mount /etc/pool.conf rc=196\n| host | volume |\n"
    rows = [
        (1, TEXTS["en"], "en"), (2, TEXTS["de"], "English"), (3, TEXTS["fr"], None), (4, TEXTS["es"] + " " + TEXTS["ko"], "es"), (5, log, "en"), (6, None, "en"), (7, "", None), (8, TEXTS["pt"], " PT-br"), (9, TEXTS["ja"], "ko"), (10, log + TEXTS["ko"], "KOR"),
        (11, (TEXTS["en"] + "\n") * 400, "n/a"), (12, TEXTS["de"] + " " + TEXTS["en"], "de"),
    ]
    df = spark.createDataFrame(rows, "k int, segments string, languages string")
    got = {tuple(r) for r in languages.label_cases(df, "k", "segments", "languages", model).collect()}
    assert got == {(2, "de"), (3, "fr"), (4, "es"), (4, "ko"), (9, "ja"), (11, "en"), (12, "de"), (12, "en")}
    assert languages.label_cases(df.limit(0), "k", "segments", "languages", model).count() == 0


def test_segments_lie_in_the_text(spark, model):
    text = TEXTS["es"] + "\n\n" + TEXTS["ko"] + "\n" + TEXTS["es"]
    df = spark.createDataFrame([(1, text)], "k int, t string")
    found = languages.language_segments(df, "t", model).first()["segments"]
    assert [s["lang_code"] for s in found] == ["es", "ko", "es"] and all(0 <= s["seg_start"] < s["seg_end"] <= len(text) and 0 <= s["confidence"] <= 1 for s in found)
    assert text[found[1]["seg_start"] : found[1]["seg_end"]] == TEXTS["ko"]


@pytest.mark.parametrize(("label", "code"), [("en-US", "en"), (" GERMAN ", "de"), ("kor", "ko"), ("und", None), ("", None), (None, None), ("n/a", None), ("pt_BR", "pt")])
def test_labels(spark, label, code):
    assert spark.createDataFrame([(label,)], "l string").select(languages.code_of(F.col("l")).alias("c")).first()["c"] == code


#: Texts in languages that nothing was learned about.
STRANGE = {
    "nl": "De server kon de verbinding met de database niet herstellen. Het bestand werd gisteren door een andere gebruiker verwijderd.",
    "it": "Il server non riesce a raggiungere il database principale. Il file cancellato ieri apparteneva a un altro utente.",
    "zh": "服务器无法连接到主数据库，请检查网络设置。该文件昨天被其他用户删除了。",
}
PARTS = {
    "en": (["The backup job", "The media server", "The tape drive", "The client agent", "The catalog", "The storage pool"], ["stopped after the update", "needs more free space", "was moved to another host", "skips all changed files", "repeats the same warning", "refuses the new certificate"], ["since last week", "every night", "before the restart", "without any message"]),
    "es": (["La copia", "El servidor", "La unidad de cinta", "El agente", "El catálogo", "El almacén"], ["se detuvo tras la actualización", "necesita más espacio libre", "se movió a otro equipo", "omite los archivos modificados", "repite la misma advertencia", "rechaza el certificado nuevo"], ["desde la semana pasada", "todas las noches", "antes del reinicio", "sin ningún mensaje"]),
    "pt": (["A cópia", "O servidor", "A unidade de fita", "O agente", "O catálogo", "O repositório"], ["parou depois da atualização", "precisa de mais espaço livre", "foi movido para outra máquina", "ignora os arquivos alterados", "repete o mesmo aviso", "recusa o novo certificado"], ["desde a semana passada", "todas as noites", "antes do reinício", "sem nenhuma mensagem"]),
    "de": (["Die Sicherung", "Der Server", "Das Bandlaufwerk", "Der Agent", "Der Katalog", "Der Speicher"], ["brach nach der Aktualisierung ab", "benötigt mehr freien Platz", "wurde auf einen anderen Rechner verlegt", "überspringt geänderte Dateien", "wiederholt dieselbe Warnung", "verweigert das neue Zertifikat"], ["seit letzter Woche", "jede Nacht", "vor dem Neustart", "ohne jede Meldung"]),
}


def _said(rng, lang, n):
    who, what, when = PARTS[lang]
    return [f"{rng.choice(who)} {rng.choice(what)} {rng.choice(when)}." for _ in range(n)]


def test_wrong_labels_quotes_and_single_sentences(spark):
    """Precision and recall with an eighth of the training labels wrong, quotes, and inserts of one sentence."""
    rng = np.random.default_rng(4)
    langs = sorted(PARTS)
    train = [(" ".join(_said(rng, lang, 8)), lang if k % 8 else langs[(langs.index(lang) + 1 + k % 3) % 4]) for lang in langs for k in range(200)]
    model = languages.Compressors(*languages.train(spark.createDataFrame(train, "text string, lang string")))
    want, got = set(), set()
    for k in range(200):
        lang, other = langs[k % 4], langs[(k % 4 + 1 + k // 4 % 3) % 4]
        parts = _said(rng, lang, 5)
        kind = k // 4 % 3
        if kind:
            insert = _said(rng, other, 1)[0]
            parts.insert(int(rng.integers(6)), insert if kind == 1 else f"“{insert}”")
        want |= {(k, lang)} | ({(k, other)} if kind else set())
        got |= {(k, s[2]) for s in languages.segments(" ".join(parts), model)}
    assert len(want & got) >= 0.95 * len(got) and len(want & got) >= 0.95 * len(want), (sorted(got - want)[:9], sorted(want - got)[:9])


def test_unknown_languages_are_rejected(model):
    known = languages.Compressors(*model)
    for lang, text in STRANGE.items():
        assert {s[2] for s in languages.segments(text, known)} == {languages.UNKNOWN}, lang
    mixed = languages.segments(TEXTS["en"] + "\n" + STRANGE["zh"], known)
    assert [s[2] for s in mixed] == ["en", languages.UNKNOWN]
    assert languages.segments("", known) == [] and languages.segments("a" * 100_000, known) == []


def test_dictionaries_of_any_size_are_searched_alike():
    """A sentence of a dictionary is found in it, whether that is near its bound or smaller."""
    rng = np.random.default_rng(6)
    starts = ["el servidor de medios ", "la copia del catálogo ", "el agente del cliente "]
    words = ["".join(rng.choice(list("abcdeilmnorstu"), int(rng.integers(2, 9)))) for _ in range(400)]
    lines, size = [], 0
    while size < languages.DICT_BYTES:
        lines.append(starts[len(lines) % 3] + " ".join(rng.choice(words, 12)) + ".")
        size += len(lines[-1].encode()) + 1
    raw = "\n".join(lines).encode()
    dictionaries = {"es": raw[: languages.DICT_BYTES], "pt": raw[: languages.DICT_BYTES * 7 // 8]}
    known = languages.Compressors(dictionaries, {"latin": ["es", "pt"]})
    sizes = [known.sizes(x, "latin")[1] for x in lines[: len(lines) * 3 // 4]]
    assert max(s["es"] - s["pt"] for s in sizes) < languages.APART


def test_a_full_dictionary_keeps_the_commonest_sentences(spark, monkeypatch):
    monkeypatch.setattr(languages, "DICT_BYTES", 2000)
    rng = np.random.default_rng(7)
    common = [f"This {a} stands in many of the texts." for a in ("line", "note", "rule", "hint", "step", "word", "page", "part")]
    rare = [f"The {''.join(rng.choice(list('abdeglmnorst'), 9))} was seen by {''.join(rng.choice(list('abdeglmnorst'), 8))} only." for _ in range(200)]
    rows = [(" ".join([*common, *rare[5 * k : 5 * k + 5]]), "en") for k in range(40)]
    lines = languages.train(spark.createDataFrame(rows, "text string, lang string"))[0]["en"].decode().splitlines()
    assert {x.lower() for x in common} <= set(lines) <= {x.lower() for x in common + rare}
    assert len("\n".join(lines)) <= 2000


def test_commands_with_typographic_hyphens_are_no_prose():
    assert {languages.prose(f"$ arcctl status {hyphen}l clt{hyphen}east{hyphen}14") for hyphen in "-‐‑"} == {("", "")}


def test_another_model_in_the_same_worker_is_not_taken_for_the_first():
    class Shared:
        def __init__(self, value):
            self.value = value

    a, b = (({"en": x * 50}, {"latin": ["en"]}) for x in (b"one sentence of words\n", b"another text\n"))
    first = languages._model(Shared(a))
    assert languages._model(Shared(a)) is first and languages._model(Shared(b)) is not first
