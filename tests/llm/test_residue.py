import pytest

from tidemark.llm.exemplars import labelled
from tidemark.llm.residue import Index, Vocabulary, concept, cues, drop_residue, has_slot, residue_matches, skeleton, terms

SCHEMA = "doc_id long, text string, kinds string, windows int"
TALK = """1
00:00:01,000 --> 00:00:02,000
Where did you leave the ladder?
- I told you, by the {} well.

2
00:00:03,000 --> 00:00:04,000
[door creaks]
I know, Rek. We used to dance here."""
RESIDUE = [
    "Previously on {{title}}...", "Subtitles by ${author}", "Ripped for #{release}", "<%= year %>", "Thanks to @@NAME@@ and Rek for the timing.", "__SITE_URL__", "[[show]] - %FPS%", "Dear {0}, welcome.", "[INSERT LANG NAME HERE]",
    "Traducido por %(title)s", "$director$", ":SHOW: - {% year %}", "<your name here>",
    "Lorem ipsum dolor sit amet, consectetur", "Ullamco irure magna nulla dolor", "Type your text here", "DUMMY LINE, NO TEXT YET", "[untranslated line]", "TODO: translate this line", "xxxx TRANSLATE ME xxxx", "Hier steht Ihr Text",
    "404 Not Found", "HTTP/1.1 503 Service Unavailable", "Forbidden [403]", "Page introuvable", "Connection timed out", "You do not have permission to view this subtitle.", "Traceback (most recent call last):",
    "Please enable JavaScript to view this page.", "Please complete the captcha to prove you are not a robot.", "Checking your browser before you continue...", "Necesita activar JavaScript para ver este contenido.", "P1ease enab1e JavaScript to vievv this pagc.",
]
SPEECH = [
    'On the board it says "{{name}}", Rek.', '"[[link]]" is how they write it in Melen.', "You type “${title}” and the machine swaps it.", 'It printed "%s" 9 times, what is that?', "[INSERTS COIN]", "It costs $17, not a cent more.", "{\\an8}We open at 7.",
    "Printers say lorem ipsum when they have no text.", "The exam had a TODO list, Rek.", "Write your name here. No, here.", "Page not found, like the rest of the diary.", "I got a 404 on that page again, Rek.", "Access denied? To my own window?", "Room 503. Service was terrible.",
    "Error is human, Rek.", "The server is down. The waiter, I mean.", "They teach JavaScript at the school now.", "So I switched JavaScript off and the drum still worked.", "Are you a robot, Rek?", "Try again later, they said. It was at noon.", "Enable what? I can't even find the drum.", '<font color="#ffcc00">Rek!</font>',
]


def corpus():
    """Residue and speech among real cues, so that frequencies are those of talk."""
    rows, i = [], 0
    for want, lines in ((True, RESIDUE), (False, SPEECH)):
        for line in lines:
            i += 1
            rows.append((i, TALK.format("old") + f"\n\n3\n00:00:05,000 --> 00:00:06,000\n{line}\n", want))
    rows += [(1000 + k, TALK.format("new"), False) for k in range(300)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_residue_is_found_and_talk_about_it_is_not(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t, _ in rows], SCHEMA)
    got = {r["doc_id"]: r for r in residue_matches(df).collect()}
    text = {i: t.splitlines()[-1] for i, t, _ in rows}
    want = {i for i, _, w in rows if w}
    assert [text[i] for i in sorted(want - set(got))] == [] and [text[i] for i in sorted(set(got) - want)] == []
    kinds = {text[i]: got[i]["kinds"] for i in want}
    assert kinds["__SITE_URL__"] == ["slot"] and kinds["404 Not Found"] == ["error"] and kinds["Type your text here"] == ["filler"] and kinds["Checking your browser before you continue..."] == ["notice"]
    kept = drop_residue(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _, w in rows if not w}


def test_whole_pages_without_cues(spark, rows):
    pages = [(1, "<html><head><title>502 Bad Gateway</title></head><body><p>502 Bad Gateway</p>\n<p>nginx</p></body></html>"), (2, "JavaScript is disabled in your browser.\nTurn it on and reload to read the subtitles."), (3, "<html><body><pre>\n" + TALK.format("red") + "</pre></body></html>"), (4, "404\n\nTalk.")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in pages] + [(i + 10, t, "x", 0) for i, t, w in rows if not w], SCHEMA)
    assert {r["doc_id"] for r in residue_matches(df).collect()} == {1, 2}


def test_nulls_empty_repeats_and_long_texts(spark, rows):
    long = "\n\n".join([TALK.format("old")] * 3000 + ["Please enable JavaScript"] + ["x" * 100_000, "{" * 20_000, "[" * 20_000, "__" * 20_000, "%a" * 20_000, "<" * 5_000])
    extra = [(None, "404 Not Found", "x", 0), (5000, None, "x", 0), (5001, "", "x", 0), (5002, long, "x", 0), (5003, "404 Not Found", "x", 0), (5003, "404 Not Found", "x", 0)]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t, w in rows if not w] + extra, SCHEMA)
    assert sorted(r["doc_id"] or 0 for r in residue_matches(df).collect()) == [0, 5002, 5003, 5003]
    assert residue_matches(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_window_that_matches_lacks_an_anchor():
    """Passing over windows without anchors loses nothing: against the same scores without them."""
    index = Index({"you": 900, "the": 950, "is": 900, "not": 500, concept("page"): 20, "found": 10}, 1000)
    everything = Index({"you": 900, "the": 950, "is": 900, "not": 500, concept("page"): 20, "found": 10}, 1000)
    everything.anchors = everything.words
    vocabulary = sorted(Index.vocabulary())
    import random

    rng, seen = random.Random(4), 0
    for _ in range(4000):
        _, _, words = index.exemplars[rng.randrange(len(index.exemplars))]
        window = dict.fromkeys([w for w in words if rng.random() < 0.85] + rng.sample(vocabulary, rng.randrange(0, 3)), False)
        assert index.best(window) == everything.best(window)
        seen += index.best(window) is not None
    assert 500 < seen < 3900


def test_each_exemplar_alone_in_a_cue_is_found(spark, rows):
    """The pre-screen of texts and cues loses no exemplar, those known by their status number least of all; a number alone is none."""
    shown = [t for _, t in labelled()]
    alone = [t for t in shown if Index({}, 1000).best(terms(t))]
    assert len(alone) >= len(shown) - 3
    alone += ["Error 503", "HTTP 404", "HTTP Error 500", "502 error", "Status code 500", "410 Gone", "Error_404"]
    cue = TALK.format("old") + "\n\n3\n00:00:05,000 --> 00:00:06,000\n"
    talk = ["The 404.", "A 500", "I said 451, you.", "500", "450, the lot."]
    texts = [cue + t + "\n" for t in alone] + alone + [cue + t + "\n" for t in talk]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)] + [(10_000 + i, t, "x", 0) for i, t, w in rows if not w] + [(20_000 + k, TALK.format("new") + " Gone.", "x", 0) for k in range(4000)], SCHEMA)
    got = {r["doc_id"] for r in residue_matches(df).collect()}
    assert [texts[i] for i in range(2 * len(alone)) if i not in got] == []
    assert [i for i in sorted(got) if i >= 2 * len(alone)] == []


def test_messages_cut_over_cues(spark, rows):
    """A message may run on in the next cue; talk beside it, or cut the same way, is none."""
    cut = [("This site requires cookies", "and scripts to work properly"), ("You do not have permission", "to view this subtitle."), ("The server took", "too long to respond."), ("Please enable", "JavaScript to view", "this page.")]
    talk = [("I got a 404", "on that page again, Rek."), ("Are you a robot,", "Rek?"), ("They teach JavaScript", "at the school now."), ("The server is down.", "The waiter, I mean.")]
    spread = lambda parts: TALK.format("old") + "".join(f"\n\n{k + 3}\n00:00:{k + 10},000 --> 00:00:{k + 11},000\n{p}" for k, p in enumerate(parts)) + "\n\n9\n00:00:30,000 --> 00:00:31,000\nWe used to dance here.\n"
    df = spark.createDataFrame([(i, spread(p), "x", 0) for i, p in enumerate([*cut, *talk])] + [(100 + i, t, "x", 0) for i, t, w in rows if not w], SCHEMA)
    assert {r["doc_id"] for r in residue_matches(df).collect()} == set(range(len(cut)))


def test_messages_wrapped_over_many_lines(spark, rows):
    """No number of lines or cues is too many for a message; windows are as long as exemplars are."""
    message = "The server is temporarily unable to service your request. Please try again later.".split()
    block = TALK.format("old") + "\n\n7\n00:00:07,000 --> 00:00:08,000\n" + "\n".join(message)
    spread = TALK.format("old") + "".join(f"\n\n{k + 3}\n00:00:{k + 10},000 --> 00:00:{k + 11},000\n{w}" for k, w in enumerate(message)) + "\n"
    df = spark.createDataFrame([(1, block, "x", 0), (2, spread, "x", 0)] + [(100 + i, t, "x", 0) for i, t, w in rows if not w], SCHEMA)
    assert {r["doc_id"] for r in residue_matches(df).collect()} == {1, 2}


UNSEEN = [
    "You have to activate JavaScript before this site runs.", "Cookies need to be allowed on this page.", "Please verify you are no robot before you continue", "Your browser is unsupported", "The server gave no response.",
    "The proxy gave no answer", "Retry after 9 seconds", "Page missing or removed: page not found", "{{#each rows}}", "[% block %]", "{{ person.first | title }}", "Hello ${customer.name}", "Placeholder caption", "Enter your caption text",
    "Fatal error: Uncaught TypeError in /srv/app/view.php on line 71", "Warning: implode() in render.php on line 9",
]


def test_wordings_no_exemplar_has(spark, rows):
    """Concepts and structures carry exemplars over to other wordings; none of these is one."""
    assert not {t.lower() for t in UNSEEN} & {t.lower() for _, t in labelled()}
    cue = TALK.format("old") + "\n\n3\n00:00:05,000 --> 00:00:06,000\n"
    df = spark.createDataFrame([(i, cue + t + "\n", "x", 0) for i, t in enumerate(UNSEEN)] + [(100 + i, t, "x", 0) for i, t, w in rows if not w], SCHEMA)
    got = {r["doc_id"] for r in residue_matches(df).collect()}
    assert all(i < 100 for i in got) and len(got) >= 0.8 * len(UNSEEN), [t for i, t in enumerate(UNSEEN) if i not in got]


def test_slots_are_scored_like_other_terms():
    """A slot weighs much, yet a long passage of speech may outweigh it; one without an exemplar of its form is none."""
    index = Index({}, 1000)
    assert index.best(terms("Subtitles by {{name}}")) and index.best(terms("${a}"))
    speech = " ".join(f"word{chr(97 + k)}{chr(97 + k // 5)}" for k in range(25))
    assert index.best(terms(f"{speech} {{{{name}}}}")) is None
    only = Index({}, 1000, exemplars=[("slot", "{{x}}")])
    assert only.best(terms("{{name}}")) and only.best(terms("${name}")) is None


def test_own_exemplars(spark):
    df = spark.createDataFrame([(1, "The kettle is out of order", "x", 0), (2, "Page not found", "x", 0)] + [(10 + k, TALK.format("The window is"), "x", 0) for k in range(50)], SCHEMA)
    assert [(r["doc_id"], r["kinds"]) for r in residue_matches(df, exemplars=[("sign", "kettle out of order")]).collect()] == [(1, ["sign"])]
    assert [r["doc_id"] for r in drop_residue(df, exemplars=[("sign", "kettle out of order")]).collect()] == [2, *range(10, 60)]


def test_parts():
    assert has_slot("a {{b}}") and not has_slot("a {\\an8} [INSERTS COIN] 12:30:11 WOMAN: #3 50% $3")
    assert "\x02quoted" in terms('He wrote "{{x}}"') and skeleton("{{x}}") in terms("By {{x}}")
    assert skeleton("{{{ a.b | c }}}") == skeleton("{{#each x}}") == skeleton("{{name}}") != skeleton("${name}")
    assert concept("cnabicci") == concept("activatc") and concept("rcrnovcci") == concept("rnissing") and concept("horsc") == "horsc"
    assert terms("I saw Rek there")["rck"] and not terms("Rek was there")["rck"]
    assert Vocabulary(frozenset({concept("pagc")})).of("The p4ge, or pages.") == {concept("pagc")}
    assert list(cues("1\n00:01 --> 00:02\nA\nBOY: B\n\n2\n00:03 --> 00:04\nC")) == [["A", "B"], ["C"]]
