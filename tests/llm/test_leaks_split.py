from cohortloom.llm.leaks import SuffixAutomaton, clean_text, leaked_spans, words_of


def test_cleaning_tries_parts_of_a_divided_word():
    """The vocabulary has the joined word and its parts; the item has the parts."""
    item = words_of("the patient had a follow up visit after the second operation in the north wing")
    other = words_of("a followup of all persons was planned by the team of the new clinic")
    a = SuffixAutomaton([(1, item), (2, other)])
    text = "Some words before. The patient had a follow-\nup visit after the second operation in the north wing. And here are more words that follow behind the span."
    n, leaked, clean = clean_text(text, leaked_spans(text, a), 0.9)
    assert leaked == 14 and clean.startswith("Some words before. ") and "patient" not in clean and "north" not in clean
    assert n == len(words_of(text))
