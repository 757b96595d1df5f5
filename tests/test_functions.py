import random

import pytest

from hanagram.functions import codec, marks
from hanagram.functions.classes import PY_RUN
from hanagram.functions.normalize import Normalizer, filter_key_text, read_groups, variant_classes, year_text
from hanagram.functions.tokens import located, phrases, tokens

JA = Normalizer(("ja",))


@pytest.mark.parametrize(
    "given, folded",
    [("東京帝國大學", "東京帝国大学"), ("サクラ", "さくら"), ("ＩＩＩＦ　２０２４", "iiif 2024"), ("佐々木", "佐佐木"), ("珊\U000e0100瑚", "珊瑚"), ("佐\U000e0101々木", "佐佐木"), ("圖\U000e0100", "図"), ("々", "々"), (None, "")],
)
def test_normalize(given, folded):
    assert JA.text(given) == folded


def test_column_folds_like_text(spark):
    texts = ["東京帝國大學", "佐々木々", "ＡＢＣ ｱｲｳ", "", None, "Straße É ﬁ", "圖\U000e0100", "々x"]
    many = Normalizer(({"龘": "りゅう", "國": "国"},))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + ["龘々國"])], "i int, s string")
    for n in (JA, many):
        got = {r[0]: r[1] for r in df.select("i", n.column("s")).collect()}
        assert got == {i: n.text(t) for i, t in enumerate(texts + ["龘々國"])}


def test_phrases():
    assert phrases(JA, "鳥瞰圖 IIIF") == [[("鳥瞰", 0), ("瞰図", 1)], [("iiif", 4)]]
    assert phrases(JA, "第1輯") == [[("第", 0), ("1", 1), ("輯", 2)]]
    assert phrases(JA, "竹") == [[("竹", 0)]]
    assert phrases(JA, "、 ・") == []


def test_runs_cover_any_text():
    rng = random.Random(1)
    for _ in range(200):
        s = "".join(rng.choice("東京a b・ー々1、\n\t🙂ｱ가") for _ in range(rng.randrange(30)))
        assert "".join(m[0] for m in PY_RUN.finditer(s)) == s


def test_token_columns_equal_located(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("東京大a bc・ー々1、🙂가") for _ in range(rng.randrange(80))) for _ in range(60)] + [""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    for unigrams in (True, False):
        got = {r[0]: sorted((t["token"], t["pos"]) for t in r[1]) for r in df.select("i", tokens("s", unigrams)).collect()}
        for i, t in enumerate(texts):
            into = {}
            located(t, 0, unigrams, into)
            assert got[i] == sorted((k, p) for k, ps in into.items() for p in ps)


def test_codec():
    assert [len(codec.number(n)) for n in (0, 59, 60, 1799, 1800, 53999, 54000)] == [1, 1, 2, 2, 3, 3, 4]
    assert len(codec.DIGITS) == 90 and not set('"\\') & set(codec.DIGITS)
    rng = random.Random(3)
    for _ in range(50):
        entries = [(d, f, sorted(rng.sample(range(20000), rng.randrange(1, 40)))) for d in sorted(rng.sample(range(5000), 6)) for f in sorted(rng.sample(range(3), 2))]
        assert codec.decode(codec.encode(entries, 3), 3) == entries
    assert codec.decode_flat([0, 0, 1, 1, 0, 1, 1, 0]) == [(0, 0, [1]), (0, 1, [0])]


def test_variant_classes(tmp_path):
    assert variant_classes([[("圖", "図")], [("圖", "图")]]) == {"圖": "図", "图": "図"}
    path = tmp_path / "own.tsv"
    path.write_text("# a comment\n\n嶋\t嶌\t島\n株式会社\t㍿\n与\t與\n", encoding="utf-8")
    assert read_groups(str(path)) == [("嶌", "嶋"), ("島", "嶋"), ("與", "与")]
    path.write_text("a\tbc\n", encoding="utf-8")
    with pytest.raises(ValueError, match=":1:"):
        read_groups(str(path))
    with pytest.raises(ValueError):
        Normalizer(("nope",))


def test_digest_check():
    JA.check(["ja"], JA.digest)
    JA.check(["ja"], None)
    with pytest.raises(ValueError):
        JA.check(["zh"], None)
    with pytest.raises(ValueError):
        JA.check(["ja"], "0" * 16)


def test_years_and_keys():
    assert [year_text(JA, v) for v in ("1900-01-01", "１９３１年", 1923, "明治33年", None)] == [1900, 1931, 1923, None, None]
    assert filter_key_text(JA, " 明治 \t 圖 ") == "明治 図"


def test_marks():
    assert marks.highlighted(JA, "東京帝國大學<b>", "帝国大学") == "東京<mark>帝國大學</mark>&lt;b&gt;"
    assert marks.highlighted(JA, "サクラと桜", "さくら 桜") == "<mark>サクラ</mark>と<mark>桜</mark>"
    assert marks.highlighted(JA, "佐々木", "佐佐木") == "<mark>佐々木</mark>"
    assert marks.excerpted(JA, "あ" * 100 + "鳥瞰圖" + "い" * 100, "鳥瞰図", 20) == "…ああああああ<mark>鳥瞰圖</mark>いいいいいいいいいいい…"
    assert marks.highlighted(JA, "珊\U000e0100瑚", "珊") == "<mark>珊\U000e0100</mark>瑚"
    assert marks.highlighted(JA, "ｶﾞｽ", "がす") == "<mark>ｶﾞｽ</mark>"
    assert marks.highlighted(JA, None, "x") == "" and marks.excerpted(JA, "abcdef", "x", 3) == "abc…"


def test_occurrences_equal_located():
    import random

    from hanagram.functions.positional import grouped, occurrences
    from hanagram.functions.tokens import located

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab東京大学図 、。x1é🙂ー々\n") for _ in range(rng.randrange(50))) for _ in range(500)] + ["", "東", "a"]
    for unigrams in (True, False):
        tokens, token, text, position = occurrences(texts, unigrams)
        names = tokens.to_pylist()
        rows, numbers, bounds, positions = grouped(token, text, position)
        got = {}
        for r, k, lo, hi in zip(rows.tolist(), numbers.tolist(), bounds, bounds[1:]):
            got.setdefault(r, {})[names[k]] = positions[lo:hi].tolist()
        for i, t in enumerate(texts):
            want = {}
            located(t, 0, unigrams, want)
            assert got.get(i, {}) == want
