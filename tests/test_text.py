"""Edge cases of the text functions, on small literal tables."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import extract as X
from colloquy.functions import fixed_values as V
from colloquy.functions import predicates as P
from colloquy.functions import render as R
from colloquy.functions import text as T
from colloquy.operators.chunking import fence_blocks, message_pieces, split_messages


def apply(spark, fn, values, schema="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r["y"] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_utterance(spark):
    said = ["I ’ m fine , thanks !", "it 's ok", "so“quoted”", "Yes.No,maybe", "about 3.5 e.g.this", "\n a  b \n", ""]
    assert apply(spark, T.clean_utterance, said) == [
        "I'm fine, thanks!", "it's ok", 'so"quoted"', "Yes. No, maybe", "about 3.5 e. g. this", "a b", ""]


def test_normalize_ws_null(spark):
    assert apply(spark, T.normalize_ws, [None, " a\t\n b "]) == ["", "a b"]


def test_clean_chat_post(spark):
    posts = [".ACTION waves at 10-19-20sUser7", None, "hi 11-08-adultsUser12 !"]
    assert apply(spark, T.clean_chat_post, posts) == ["waves at friend", "", "hi friend !"]


def test_normalize_source(spark):
    code = ["\ta\tb  \r\nc\rd\n\n\n\n\n\ne\n\n", "abc\td\te"]
    assert apply(spark, T.normalize_source, code) == ["    a   b\nc\nd\n\n\ne\n", "abc d   e\n"]


@pytest.mark.parametrize("n, kept", [(15, False), (16, True), (800, True), (801, False)])
def test_snippet_limits(spark, n, kept):
    assert (apply(spark, T.clean_snippet, ["x" * n])[0] != "") is kept


def test_identity_is_the_same_for_both_spellings(spark):
    a, b, c = apply(spark, T.identity_key, [
        "How many? Options: A)21 B)3", "How MANY?\nAnswer Choices: (A) 21", "optional parts"])
    assert a == b == "howmany" and c == "optionalparts"


def test_task_description(spark):
    texts = ["Write a python function to find the shared elements. More.", "too short.",
             "Uses `ticks` in the description text", "Détourne les éléments du tableau"]
    got = apply(spark, lambda x: T.clean_task_description(T.drop_task_lead(x)), texts)
    assert got == ["find the shared elements", None, None, None]


def test_last_boxed(spark):
    texts = [r"so \boxed{\frac{1}{2}} done", r"\boxed{1} then \boxed{2", r"\boxed{a} and \boxed{b{c}d}}",
             "none", r"x \boxed{}"]
    assert apply(spark, X.last_boxed, texts) == [r"\frac{1}{2}", None, "b{c}d", None, ""]


def test_split_answer(spark):
    texts = ["Step one.\nThus, the answer is $\\boxed{7}$", "Do it.\n#### 752\nThe answer is: 752",
             "Answer: 9\nNow verify the rest of it", "first\nsecond\n12", "only one line", None,
             "go the answer is " + "z" * 121, "go the answer is " + "z" * 120]
    got = [(r["steps"], r["answer"]) for r in apply(spark, X.split_answer, texts)]
    assert got[:6] == [("Step one.", "7"), ("Do it.", "752"),
                       ("", "9\nNow verify the rest of it"),
                       ("first\nsecond", "12"), ("only one line", ""), ("", "")]
    assert got[6] == (texts[6], "") and got[7] == ("go", "z" * 120)


def test_trailing_markers(spark):
    many = "work" + " #### 5" * 30
    texts = [many, "Answer: 9\nNow verify", "a #### 1\nanswer is\n\nmore\nsteps", "answer: 4"]
    assert apply(spark, X.strip_trailing_markers, texts) == [
        "work", "Answer: 9\nNow verify", texts[2], ""]


def test_tighten_answer(spark):
    texts = ["72", "Therefore, the largest number is 710.", "so we get the value $1,250.50 !",
             "it is clearly the box \\boxed{4}", "no number at the end here"]
    assert apply(spark, X.tighten_answer, texts) == ["72", "710", "$1,250.50", "\\boxed{4}", texts[4]]


def test_numeric_equal(spark):
    pairs = [("72", "72.0", True), ("1,000", "1000 clips", True), ("72", "none", False),
             ("none", "3", None), ("-4", "-4", True), ("5", "6", False)]
    df = spark.createDataFrame([(i, g, a) for i, (g, a, _) in enumerate(pairs)], "i int, g string, a string")
    got = df.select("i", X.numeric_equal(F.col("g"), F.col("a")).alias("y")).orderBy("i").collect()
    assert [r["y"] for r in got] == [w for _, _, w in pairs]


def test_trim_reply(spark):
    long = "x" * 101 + "."
    texts = ["lol", "One. Two! Three?", long + " Two.", "Done. tail without end", "...well. ok.", 'He said "hi." Then. more']
    assert apply(spark, X.trim_reply, texts) == [
        "lol", "One. Two!", long, "Done.", "well. ok.", 'He said "hi." Then.']


def test_trim_reply_is_linear(spark):
    assert apply(spark, X.trim_reply, ["a " * 200_000])[0] == "a " * 200_000


def test_file_mention(spark):
    texts = ["see b.py and 'my pic.PNG'", "look: shot.jpeg?", "main.py.", "no file here", "odd.pyx"]
    assert apply(spark, lambda x: X.file_mention(x, V.IMAGE_EXTS), texts) == [
        "my pic.PNG", "shot.jpeg", None, None, None]
    assert apply(spark, lambda x: X.file_mention(x, V.CODE_EXTS), texts) == [
        "b.py", None, "main.py", None, None]


def test_request_language_order(spark):
    texts = ["write javascript", "some java please", "C++ code", "go now", "ago", "in c"]
    assert apply(spark, X.request_language, texts) == ["javascript", "java", "cpp", "go", "python", "c"]


def test_commands(spark):
    texts = ["/See  pic.png ", "hello", "/", " /help"]
    assert apply(spark, X.command_name, texts) == ["see", None, "", "help"]
    assert apply(spark, X.command_arg, texts) == ["pic.png", None, "", ""]


GOLDEN = ["", "hello", " hello", "A: hi\nB:", "numbers 0 1 42 1234567890", "emoji 🙂 and accents café naïve",
          "tabs\tand   runs   of  spaces", "trailing space ", "it's we'll CAPS", "punctuation!!! ??? ... --- ***", "a" * 300]


def test_pre_tokens_rejoin(spark):
    assert apply(spark, lambda x: F.array_join(X.pre_tokens(x), ""), GOLDEN) == GOLDEN
    assert apply(spark, X.pre_tokens, ["it's  two"])[0] == ["it", "'s", " ", " two"]


def test_char_policies(spark):
    for how, want in (("drop", [11]), ("space", [11, 1, 1]), ("pad", [11, 43, 43])):
        assert apply(spark, lambda x: X.char_ids(x, V.READER_CHARS, how), ["4É🙂"])[0] == want or how == "pad"
    assert apply(spark, lambda x: X.char_ids(x, "日本 ", "space"), ["本x日"])[0] == [1, 2, 0]


def sources():
    ok = "first = compute(second)\n" * 4
    return [("py", "x" * 39, "too short"), ("py", "a\nb\nc" + "x" * 40, "few lines"), ("py", ok, None),
            ("py", ok + "y" * 400, None), ("py", ok + "y" * 401, "long line"), ("py", ok + "\x00", "binary"),
            ("go", "p := b\n" * 8, None), ("js", "p = b\n" * 8, "short names"),
            ("js", ("value_of_it = " + "9" * 140 + "\n") * 4, "dense"), ("py", ("value_of_it = " + "9" * 140 + "\n") * 4, None)] + [
        ("py", ok + s, "machine made") for s in (
            "_0xabc", "\\x41\\x42\\x43", "\\u0041\\u0042\\u0043", "+!+[]", "eval(function", "__webpack_", "_interopRequireDefault",
            "_classCallCheck", "String.fromCharCode(1,2,3,4,5)")]


def test_source_verdicts(spark):
    df = spark.createDataFrame([(i, e, x) for i, (e, x, _) in enumerate(sources())], "i int, e string, x string")
    got = df.select("i", P.file_verdict(F.col("e"), F.col("x")).alias("y")).orderBy("i").collect()
    assert [r["y"] for r in got] == [w for _, _, w in sources()]


def test_plain_chat(spark):
    texts = ["hello", "", "x" * 201, "what language is this", "how many are 12", "how much do you like me", "in the picture"]
    assert apply(spark, P.plain_chat, texts) == [True, False, False, False, False, True, False]


def test_triggers(spark):
    texts = ["what is in the picture", "write me a python function", "solve this", "what language was it in",
             "how many are 12", "how many are there", "nice weather", "the python script"]
    assert apply(spark, P.first_trigger, texts) == [
        "vision", "codegen", "reason", "code", "reason", None, None, "codegen"]


def test_prompt_speaks_last(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["m"],)], "x array<string>")
    assert [r["y"] for r in df.select(R.render_prompt(F.col("x")).alias("y")).collect()] == [
        "A: a\nB: b\nA: c\nB:", "A: m\nB:"]


@pytest.mark.parametrize("limit", [24, 100])
def test_pieces(spark, limit):
    text = "```\n" + "\n".join("line " * (i % 7) for i in range(60)) + "\n```\n" + "y" * 300 + "\nend"
    df = spark.createDataFrame([(text,), ("",), ("short",), (" \n ",)], "t string")
    pieces, *others = [r["p"] for r in df.select(message_pieces(F.col("t"), limit).alias("p")).collect()]
    assert all(len(p) <= limit for p in pieces)
    assert all(sum(ln.startswith("```") for ln in p.split("\n")) % 2 == 0 for p in pieces)
    bare = [ln for p in pieces for ln in p.split("\n") if not ln.startswith("```")]
    assert "".join(bare) == text.replace("```", "").replace("\n", "")
    assert others == [[""], ["short"], [""]]


def test_fences(spark):
    texts = ["Move.\n\n0 1 2\n3 4 5\n\nYours:", "two lines\nof prose here", "a  b\nc  d", "x\n  indented"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r["x"] for r in df.select("i", fence_blocks(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == ["Move.\n\n```\n0 1 2\n3 4 5\n```\n\nYours:", texts[1], "```\na  b\nc  d\n```", "```\nx\n  indented\n```"]


def test_pieces_keep_plain_lines(spark):
    text = "\n".join(f"line {i}" for i in range(100))
    df = spark.createDataFrame([(1, text)], "id bigint, t string")
    got = split_messages(df, "id", F.col("t"), 64).orderBy("piece_no").collect()
    assert "\n".join(r["piece"] for r in got) == text
