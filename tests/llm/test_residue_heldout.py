import residue_heldout as held
from threadloom.llm.residue import residue_kind


def test_recall_and_precision_on_held_out_texts():
    found = [t for t in held.POSITIVE if residue_kind(t)]
    wrong = [t for t in held.NEGATIVE if residue_kind(t)]
    assert len(held.POSITIVE) >= 100 and len(held.NEGATIVE) >= 100
    assert len(found) >= 0.95 * len(held.POSITIVE)
    assert len(found) >= 0.95 * (len(found) + len(wrong))
