from tidemark.plans import analysis, studies


def test_studies_have_the_reference_sizes():
    assert {c[0] for c in analysis._CASES["sensitivity"]} == {25_000} and analysis.TRIALS["sensitivity"] == 10
    assert [c[0] for c in analysis._CASES["sizes"]] == [1_000, 3_000, 5_000, 10_000, 20_000, 50_000] and analysis.TRIALS["sizes"] == 8


def test_whole_studies_have_the_reference_sizes():
    assert (studies.SIZE, studies.TRIALS, studies.SENSITIVITY_TRIALS, studies.MODERATE) == (25_000, 15, 10, 1.5)
    assert (studies.FRESH_FIRST, studies.FRESH_SIZE) == (20, 15_000) and len(studies.SHIFTS) == 3
