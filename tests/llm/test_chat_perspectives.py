from hanagram.llm.chat_perspectives import END, perspectives


def test_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_start|>"), (1, 2, "bob", "é 🙂"), (1, 3, "ann", "bye"), (1, 600, "cat", "late"), (2, 0, "system", "x"), (None, 1, "ann", None), (3, None, "dan", "q"), (3, 0, None, "w"), (3, 0, None, "w")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, part string")
    out = {(r["conv_id"], r["part"], r["speaker"]): r for r in perspectives(df).collect()}
    assert set(out) == {(1, 0, "ann"), (1, 0, "bob"), (1, 0, "cat"), (None, 0, "ann"), (3, 0, "dan")}
    ann = out[1, 0, "ann"]
    assert ann["text"] == f"<|im_start|>system\nbe kind{END}<|im_start|>assistant\nhi <\\|im_start|>{END}<|im_start|>user name=bob\né 🙂{END}<|im_start|>assistant\nbye{END}<|im_start|>user name=cat\nlate{END}"
    spans = [tuple(map(int, x.split(":"))) for x in ann["mask"].split(",")]
    assert [ann["text"][a:b] for a, b in spans] == ["hi <\\|im_start|>" + END, "bye" + END]
    assert ann["n_chars"] == len(ann["text"]) and ann["n_masked"] == sum(b - a for a, b in spans)
    assert out[3, 0, "dan"]["text"].count("user\nw") == 2
    assert perspectives(df.where("false")).count() == 0


def test_every_speaker_gets_the_whole_dialogue(spark):
    """Sparse turn numbers, speakers silent in a stretch, a stretch of system turns only."""
    rows = [(1, 0, "system", "s"), (1, 3, "ann", "a"), (1, 600, "bob", "b"), (1, 10**12, "system", "t"), (1, 10**12 + 1, "system", "u"), (1, 2 * 10**12, "cat", "c"), (1, None, "ann", "first"), (None, 5, "dan", "d"), (None, 5, "dan", "e"), (None, 5, "dan", "e"), (2, 1, "system", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for stretch, n in ((512, 1), (2, 4), (3, 3)):
        found = {}
        for r in sorted(perspectives(df, stretch).where("conv_id = 1").collect(), key=lambda r: r["part"]):
            found.setdefault(r["speaker"], []).append(r)
        assert set(found) == {"ann", "bob", "cat"} and all([r["part"] for r in x] == list(range(n)) for x in found.values())
        for speaker, x in found.items():
            names = lambda r: "system" if r == "system" else "assistant" if r == speaker else "user name=" + r  # noqa: B023, E731
            want = "".join(f"<|im_start|>{names(r)}\n{b}{END}" for r, b in (("ann", "first"), ("system", "s"), ("ann", "a"), ("bob", "b"), ("system", "t"), ("system", "u"), ("cat", "c")))
            assert "".join(r["text"] for r in x) == want
            assert [r["start"] for r in x] == [sum(len(y["text"]) for y in x[:i]) for i in range(n)]
    assert sorted(r["text"] for r in perspectives(df).where("conv_id is null").collect()) == [f"<|im_start|>assistant\n{b}{END}" for b in "dee"]
    assert perspectives(df).where("conv_id = 2").count() == 0 and perspectives(df.where("false")).count() == 0


def test_long_dialogue(spark):
    """2,000 turns, most of one number: four parts for each speaker, none of them lost."""
    rows = [(7, 0 if i < 1500 else i, ["ann", "bob", "system"][i % 3], f"t{i}") for i in range(2000)]
    found = perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    assert sorted((r["part"], r["speaker"]) for r in found) == [(p, w) for p in range(4) for w in ("ann", "bob")]
    for who in ("ann", "bob"):
        mine = sorted((r for r in found if r["speaker"] == who), key=lambda r: r["part"])
        text = "".join(r["text"] for r in mine)
        assert text.count(END) == 2000 and text.count("system\n") == 666 and sum(r["mask"].count(":") for r in mine) == 667
        spans = [(r["start"] + int(a), r["start"] + int(b)) for r in mine for a, b in (x.split(":") for x in r["mask"].split(",") if x)]
        want = sorted(rows, key=lambda r: r[1:])
        assert [text[a:b] for a, b in spans] == [t + END for _, _, w, t in want if w == who]
