from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


#: Texts that meet the operators' edges: null, empty, white space, ties, repeats, odd letters, a long one.
TEXTS = [
    None, "", " ", "\t\n\x0b\x0c\r ", "a", "A b", "a  b", " a b ", "a b\n c", "the cat's 12 toys, they'll go!\n\nNew  line",
    "Straße übergrößen ñandú œuvre", "日本語のテキスト と 漢字 123", "éa ́b \xa0c d \x1c e", "🙂🙂 emoji 🙂",
    "<|endoftext|> and <|startoftext|> here", "x" * 3000, "no-space " * 700, "same words same words same words",
    "same words same words same words", "SAME words same\twords same words", "12345", "...!?", "\x00nul \x00", "a\r\nb\r\nc",
] + ["long text " + " ".join(f"w{i % 97}x{i % 13}" for i in range(6000))]


@pytest.fixture()
def edge_docs(spark):
    """Edge texts with a repeated row and clashing extra columns."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or ""), i, "k", i) for i, t in enumerate(TEXTS)]
    rows.append(rows[9])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "kept long, row string, fp long")


@pytest.fixture()
def no_docs(edge_docs):
    return edge_docs.limit(0)
