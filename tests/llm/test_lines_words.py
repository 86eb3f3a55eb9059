from cohortlens.llm.op2_lines import RARE, delete_lines


def test_long_block_goes_however_many_hold_it(make_docs, words):
    """One line of 40 words, two of 15 and 16, one of 20, each in more than RARE documents."""
    blocks = {100: [words(1, 40)], 200: [words(2, 15), words(3, 16)], 300: [words(4, 20)]}
    rows = [(k + d, "\n".join([words(k + d, 9), *block, words(k + d + 50, 9)]))
            for k, block in blocks.items() for d in range(RARE * 2)]
    gone = {r.doc_id: list(r.gone) for r in delete_lines(make_docs(rows), report=True).collect()}
    for k, want in ((100, [1]), (200, [1, 2]), (300, [])):
        for d in range(RARE * 2):
            assert gone[k + d] == (want if d else [])
