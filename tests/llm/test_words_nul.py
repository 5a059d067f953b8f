from sparkloom.llm.charlm import words_of


def test_a_text_with_nul_keeps_its_words():
    words = words_of(["a\0b\0", None, "", "C d", "\0", "İe"])
    assert words.text.tolist() == [0, 0, 3, 3, 5, 5]
    assert words_of(["", "x", "y z"]).text.tolist() == [1, 2, 2]
