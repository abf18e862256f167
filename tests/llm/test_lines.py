"""Line de-duplication: words at any white space, and results that hang on the selected fingerprints."""

from test_operators import runs_removed

from strandlog.llm import line_dedup


def test_words_end_at_any_white_space(make, scratch):
    table = "\t".join(f"cell{i}" for i in range(60))
    out = {x.doc_id: x.text for x in line_dedup.remove_repeats(make([(1, f"first\n{table}\nend"), (2, f"other\n{table}")]), scratch()).collect()}
    assert out == {1: f"first\n{table}\nend", 2: "other"}


def test_a_run_longer_than_a_window_goes_whole(make, scratch):
    """The tail after the last window forwards, and lines between two fingerprints, go as well."""
    passage = [f"p{i} " * (1 + i % 7) for i in range(40)] + ["tail"]
    texts = ["\n".join(["alpha", *passage, "omega"]), "\n".join([*passage, "x y", *passage[5:]]), "\n".join(passage[:3])]
    out = {x.doc_id: x for x in line_dedup.remove_repeats(make(texts), scratch()).collect()}
    want = runs_removed(list(enumerate(texts)), line_dedup.MIN_WORDS)
    for i, t in enumerate(texts):
        assert out[i].text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, ()))
    assert out[1].text == "x y" and out[2].n_removed_lines == 0


def test_nothing_is_found_without_shared_fingerprints(make, scratch):
    """The stretches come from shared fingerprints alone: without these there are none."""
    long = " ".join(map(str, range(60)))
    table = scratch().put(line_dedup.fingerprints(make([(1, long), (2, long)])), "t")
    assert table.count() == 2 and line_dedup.repeated_runs(table, scratch()).count() == 1
    assert line_dedup.repeated_runs(table.limit(1), scratch()).isEmpty()
