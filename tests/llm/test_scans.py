import pytest

from skein.llm import scans

WORDS = "the backup job reported failed attempts since the replication service was moved without a new host entry before retention period ends and every client agent needs free space".split()
COUNTS = dict.fromkeys(WORDS, 500) | {"write-protected": 60, "flag": 80, "read-only": 40, "only": 300, "off-site": 30, "site": 90}


@pytest.fixture(scope="module")
def lexicon():
    return scans.Lexicon(COUNTS)


@pytest.mark.parametrize(("seen", "meant"), [("fai1ed", "failed"), ("failecl", "failed"), ("rep|ication", "replication"), ("sirice", "since"), ("@gent", "agent"), ("tbe", "the"), ("wr1te-protected", "write-protected"), ("failed", None), ("zebra", None), ("213", None)])
def test_misread(lexicon, seen, meant):
    assert lexicon.meant(seen) == meant


@pytest.mark.parametrize(("a", "b", "whole"), [("replica", "tion", "replication"), ("write", "protected", None), ("read", "only", None), ("rep1ica", "tion", "replication"), ("off", "site", None), ("VT", "12", None), ("unknow", "able", "unknowable")])
def test_hyphens(lexicon, a, b, whole):
    assert lexicon.joined(a, b) == whole


@pytest.mark.parametrize(("line", "page", "is_number"), [("12", 12, True), ("- 12 -", 12, True), ("Page 12", 12, True), ("xii", 12, True), ("l2 / 40", 12, True), ("Seite 12 | 40", 12, True), ("페이지 12", 12, True), ("213", 12, False), ("12 files", 12, False), ("", 12, False), ("Cause", 12, False), ("Pa9e 12", 12, True)])
def test_page_numbers(line, page, is_number):
    assert scans.page_number(line, page) == is_number


def test_skeletons():
    assert scans.skeleton("FOR INTERNAL USE") == scans.skeleton("  For 1nternaI use ") == scans.skeleton("For intemal use  12")
    assert scans.skeleton("Guide 9.1") == scans.skeleton("Gu1de 10.2") != scans.skeleton("Report 9.1")


def test_decode(lexicon):
    page = "Header\nthe backup job reported fai1ed at-\ntempts since the replica-\ntion service was moved with-\n\nPage 3"
    noise, lines = scans.decode(page, {1}, "out a new host entry", 3, lexicon)
    assert sorted(noise) == [(1, "header"), (2, "hyphen"), (2, "misread"), (3, "hyphen"), (4, "hyphen"), (6, "page_number")]
    assert lines[0][1] == "the backup job reported failed attempts" and lines[1][1] == "since the replication"
    assert scans.decode("", set(), None, 1, lexicon)[0] == [] and scans.decode("x-", set(), None, None, lexicon)[0] == []


def test_paragraphs():
    lines = [(k, t, False) for k, t in enumerate(["The backup job reported failed attempts since", "the replication service was moved.", "", "Every client agent needs free space", "before the retention period ends."])]
    assert [[x[0] for x in p] for p in scans.paragraphs(lines)] == [[0, 1], [3, 4]]
    assert scans.paragraphs([]) == [] and scans.paragraphs([(1, " ", False)]) == []


@pytest.fixture(scope="module")
def pages(spark):
    body = "the backup job reported failed attempts since the replication service was moved without a new host entry before the retention period ends."
    rows = []
    for p in range(1, 9):
        text = f"Vault Guide {p}\n" + "\n".join([body] * 4) + (f"\n{' '.join(WORDS[p : p + 5])} the replica-" if p < 8 else "") + f"\n\n{p}"
        if p > 1:
            text = text.replace("\nthe", "\ntion service was moved.\nthe", 1)
        rows.append((p, 1, p, text.replace("failed", "fai1ed", 1) if p == 4 else text))
    rows += [(20, 2, 1, "Vault Guide 1\n" + body), (21, 1, 4, rows[3][3]), (22, 3, 1, None), (23, None, None, body), (24, 4, 1, "")]
    return spark.createDataFrame(rows, "page_key long, file_id long, page_no int, page_content string")


def test_noise(spark, pages):
    got = {}
    for r in scans.find_noise(pages).collect():
        got.setdefault(r["page_key"], set()).add((r["line_no"], r["noise"]))
    assert got[2] == {(1, "header"), (7, "hyphen"), (9, "page_number")} and got[4] == got[2] | {(3, "misread")} == got[21]
    assert 20 not in got and 22 not in got and 24 not in got and (7, "hyphen") not in got[8]
    assert scans.find_noise(pages.limit(0)).count() == 0


def test_paragraphs_go_on_over_pages(spark, pages):
    got = scans.repaired_paragraphs(pages).where("file_id = 1").collect()
    joined = [r["paragraph"] for r in got if r["first_page"] != r["last_page"]]
    assert joined and all("replication service" in p for p in joined) and not any("Vault" in r["paragraph"] for r in got)


@pytest.mark.parametrize(("line", "read", "misread"), [("the backupjob failed", "the backup job failed", False), ("thejob", "thejob", False), ("Thejob reported", "The job reported", False), ("every backupj0b failed", "every backup job failed", True), ("the rep lica tion service", "the replication service", False), ("zebra unknowable", "zebra unknowable", False)])
def test_words_that_ran_together(lexicon, line, read, misread):
    noise, lines = scans.decode(line, set(), None, 1, lexicon)
    assert lines[0][1] == read and noise == ([(1, "misread")] if misread else [])


def test_cheapest_way_over_a_line_end(lexicon):
    assert scans.decode("the replica-\nti on service", set(), None, 1, lexicon)[1][0][1] == "the replication"
    assert scans.decode("the replica-\ntionservice failed", set(), None, 1, lexicon)[1][0][1] == "the replication service"


def test_headers_of_chapters_and_of_two_lines(spark):
    # 60 pages: all have two header lines, pages 7 to 9 a chapter's below them; one line stands on three pages by chance.
    named = lambda n: "".join("adgkopqwxy"[int(d)] * 2 for d in f"{n:04}")
    rows = []
    for p in range(1, 61):
        body = [f"{named(p * 20 + k)} runs on" for k in range(8)]
        if p in (5, 25, 45):
            body[0 if p < 45 else -1] = "a chance line of the running text"
        chapter = ["Restoring a vault"] if p in (7, 8, 9) else []
        rows.append((p, 1, p, "\n".join(["Vault Guide", "Second edition", *chapter, *body, "Support team", str(p)])))
    pages = spark.createDataFrame(rows, "page_key long, file_id long, page_no int, page_content string")
    frames = {r["page_key"]: r for r in scans.page_frames(pages).collect()}
    assert all(sorted(frames[p]["header_lines"]) == ([1, 2, 3, 12] if p in (7, 8, 9) else [1, 2, 11]) for p in range(1, 61))
    assert frames[7]["next_head"] == named(160) and frames[4]["next_head"] == "a"
    same = spark.createDataFrame([(p, 1, p, "like line\nlike line\nlike line\nlike line\nlike line") for p in range(1, 5)], pages.schema)
    assert all(sorted(r["header_lines"]) == [1, 5] for r in scans.page_frames(same).collect())


def test_rare_words_are_known_at_any_size(spark):
    # 12 million words: "fail" with 8 occurrences keeps its count, so that it is no misreading of "tail" with 20.
    common = spark.range(300).selectExpr("repeat('backup ', 40000) AS page_content")
    rare = spark.createDataFrame([("fail " * 8,), ("tail " * 20,), ("once",)], "page_content string")
    known = {r["word"]: r["n"] for r in scans.known_words(common.unionByName(rare)).collect()}
    assert known == {"backup": 12_000_000, "fail": 8, "tail": 20} and scans.Lexicon(known).meant("fail") is None


def test_a_long_paragraph_is_not_cut():
    lines = [(k, f"the backup job {'x' * 40} reported", True) for k in range(300)]
    assert [len(p) for p in scans.paragraphs(lines)] == [300]


def test_misreadings_of_very_common_words_are_judged_by_ratio_alone():
    counts = {"the": 20_000, "tbe": 120, "server": 900}
    assert scans.Lexicon(counts).fixed("tbe") == "the"
    assert scans.Lexicon({k: 1000 * n for k, n in counts.items()}).fixed("tbe") == "the"
    assert scans.Lexicon(counts | {"tbe": 12_000}).fixed("tbe") == "tbe"


def test_long_words_and_long_number_lines():
    long = "hydro" * 30
    assert scans.Lexicon({long + "m": 50, "x": 5}).fixed(long + "rn") == long + "m"
    assert scans.page_number("- - - - - -  Seite  7  von  12  - - - - - -", 7) and not scans.page_number("seven words are no number of a page 7 " * 40, 7)
    assert scans.page_words("one two-\nthree four\nfive") == ["one", "four", "five"] and scans.page_words("") == []


def test_lines_decoded_alone_read_as_in_one_stream(monkeypatch):
    counts = {w: 100 for w in "the backup server starts every night and writes files to disk".split()}
    text = "the backup server starts\nevery nig-\nht and wri tes files\nto disk tbe backupserver\nnight-\n"
    fast = scans.decode(text, set(), None, 1, scans.Lexicon(counts))
    monkeypatch.setattr(scans.Lexicon, "alone", lambda self, chunk: None)
    assert scans.decode(text, set(), None, 1, scans.Lexicon(counts)) == fast


def test_a_lexicon_too_large_to_send_gives_the_same(spark, monkeypatch):
    """With seven common words in the workers and all others joined on, page by page."""
    common = "the backup server starts every night and writes all changed files to disk before the window ends".split()
    pages = []
    for k in range(24):
        body = " ".join(common[(k + j) % len(common)] for j in range(40))
        text = f"Night Report\n{body} re-\nstored files-\nystem tbe backupserver wri tes nlght {k + 1}\nco-ordi-\nnated sys-\ntem {'restored system coordinated filesystem' if k % 2 else ''}\n{k + 1}"
        pages.append((k, k // 12, k % 12 + 1, text))
    df = spark.createDataFrame([*pages, (99, 5, 1, None)], "page_key long, file_id long, page_no int, page_content string")
    noise = lambda: sorted(map(tuple, scans.find_noise(df).collect()))
    paragraphs = lambda: sorted(map(tuple, scans.repaired_paragraphs(df).collect()))
    whole = noise(), paragraphs()
    assert {x[2] for x in whole[0]} >= {"hyphen", "header", "page_number"}
    monkeypatch.setattr(scans, "LEXICON_WORDS", 7)
    assert (noise(), paragraphs()) == whole
