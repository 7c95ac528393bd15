"""Look-alikes, hidden characters and forms; real words of other scripts stay."""

import pytest
from helpers import line_items

from quayside.llm.glyphs import disguised, normalise, normalise_texts

CASES = [
    ("517 рісе", "517 pice", "whole"), ("САЅНЕW КERΝELS", "CASHEW KERNELS", "mixed"), ("kɡ", "kg", "latin_twin"), ("5 \u212a", "5 K", "form"), ("ｓａｔｉｎ １２", "satin 12", "form"), ("𝟷𝟸 kg", "12 kg", "form"),
    ("1\u00a0500", "1 500", "space"), ("1​500", "1500", "invisible"), ("Gönwoka", "Gönwoka", "accent"), ("PVC‑pipe", "PVC-pipe", "dash"), ("ﬁne", "fine", "form"), ("Гoссия Pоссия", "Госсия Россия", "mixed"),
    ("Gагlic", "Garlic", "mixed"), ("gгain", "grain", "mixed"), ("тotal", "total", "mixed"), ("пet", "net", "mixed"), ("Ꭺpple", "Apple", "mixed"), ("ꓐag", "Bag", "mixed"), ("ᴄotton", "cotton", "latin_twin"), ("12∕40", "12/40", "sign"), ("Ctnʼs", "Ctn's", "sign"),
]
PLAIN = ["", "plain 12", "Gönwoka Sélulque", "Ελλάδα", "УКРАЇНА", "партия 14", "附件见规格", "شحنة جزئية", "मानक नमूना", "10 m² ½ №7 ™ ® ° ± ★", "a\tb   c", "đóng gói", "Việt Nam", "ประเทศไทย"]


@pytest.mark.parametrize(("text", "want", "kind"), CASES)
def test_disguises(text, want, kind):
    found, kinds = normalise(text)
    assert found == want and kind in kinds


@pytest.mark.parametrize("text", PLAIN)
def test_plain_texts_stay(text):
    assert normalise(text) == (text, [])


def test_tables(spark):
    rows = [{"line_id": k, "quote": q} for k, q in enumerate([c[0] for c in CASES] + PLAIN + [None, "рісе " * 20_000])] + [{"line_id": 0, "quote": CASES[0][0]}]
    table = line_items(spark, *rows, text="x", kinds="y", n=1)
    found = sorted(r["line_id"] for r in disguised(table, "line_id", "quote").collect())
    assert found == [0, *range(len(CASES)), len(rows) - 2]
    whole = {r["line_id"]: r["text"] for r in normalise_texts(table, "line_id", "quote").collect()}
    assert whole[1] == CASES[1][1] and whole[len(CASES) + len(PLAIN)] is None and len(whole) == len(rows) - 1
    assert disguised(line_items(spark), "line_id", "quote").count() == 0
