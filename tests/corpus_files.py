"""A small corpus in files: three bundles, five levels."""

import json

CONFIG = {
    "name": "fx", "UUID": "fx-0001", "mediafileExtension": "wav",
    "levelDefinitions": [
        {"name": "Word", "type": "ITEM", "attributeDefinitions": [{"name": "Word", "type": "STRING"}, {"name": "Accent", "type": "STRING"}]},
        *({"name": n, "type": t, "attributeDefinitions": [{"name": n, "type": "STRING"}]} for n, t in (("Syllable", "ITEM"), ("Phoneme", "ITEM"), ("Phonetic", "SEGMENT"), ("Tone", "EVENT"))),
    ],
    "linkDefinitions": [{"type": t, "superlevelName": a, "sublevelName": b} for a, b, t in (("Word", "Syllable", "ONE_TO_MANY"), ("Syllable", "Phoneme", "ONE_TO_MANY"), ("Phoneme", "Phonetic", "MANY_TO_MANY"), ("Syllable", "Tone", "ONE_TO_MANY"))],
    "ssffTrackDefinitions": [{"name": "fm", "columnName": "fm", "fileExtension": "fms"}],
}

BUNDLES = {
    ("S1", "B1"): (
        {"Word": "1:cat/S 2:sunny/W", "Syllable": "3:S 4:S 5:W", "Phoneme": "6:k 7:a 8:t 9:s 10:a 11:n 12:n 13:i", "Phonetic": "14:k[0,80] 15:a[80,120] 16:t[200,60] 17:s[260,100] 18:a[360,110] 19:n[470,140] 20:i[610,90]", "Tone": "21:H*@100 22:L-@650"},
        "1-3 2-4 2-5 3-6 3-7 3-8 4-9 4-10 4-11 5-12 5-13 6-14 7-15 8-16 9-17 10-18 11-19 12-19 13-20 3-21 5-22",
    ),
    ("S1", "B2"): ({"Word": "1:tan/S", "Syllable": "2:S", "Phoneme": "3:t 4:a 5:n", "Phonetic": "6:t[0,60] 7:a[60,130] 8:n[190,110]"}, "1-2 2-3 2-4 2-5 3-6 4-7 5-8"),
    ("S2", "B3"): ({"Word": "1:a/W 6:uh/W", "Syllable": "2:W", "Phoneme": "3:a 4:", "Phonetic": "5:a[0,150]"}, "1-2 2-3 2-4 3-5"),
}


def _item(level, text):
    number, _, rest = text.partition(":")
    item = {"id": int(number)}
    if "[" in rest:
        rest, _, at = rest.partition("[")
        item["sampleStart"], item["sampleDur"] = map(int, at[:-1].split(","))
    if "@" in rest:
        rest, _, at = rest.partition("@")
        item["samplePoint"] = int(at)
    label, _, accent = rest.partition("/")
    item["labels"] = [{"name": level, "value": label}] + ([{"name": "Accent", "value": accent}] if accent else [])
    return item


def write(folder):
    (folder / "fx_DBconfig.json").write_text(json.dumps(CONFIG))
    (folder / "METADATA.json").write_text('{"Country": "USA", "Language": "English"}')
    for (session, bundle), (levels, links) in BUNDLES.items():
        at = folder / f"{session}_ses" / f"{bundle}_bndl"
        at.mkdir(parents=True)
        types = {x["name"]: x["type"] for x in CONFIG["levelDefinitions"]}
        body = {
            "name": bundle, "annotates": f"{bundle}.wav", "sampleRate": 1000.0,
            "levels": [{"name": n, "type": t, "items": [_item(n, x) for x in levels.get(n, "").split()]} for n, t in types.items()],
            "links": [dict(zip(("fromID", "toID"), map(int, x.split("-")), strict=True)) for x in links.split()],
        }
        (at / f"{bundle}_annot.json").write_text(json.dumps(body))
        (at / f"{bundle}.wav").write_bytes(bundle.encode())
    (folder / "S1_ses" / "METADATA.json").write_text('[{"Dialect": "Northern", "Gender": "Female", "Age": 9}]')
    (folder / "S1_ses" / "B1_bndl" / "METADATA.json").write_text('{"Speaker": "S001", "Country": "Canada"}')
    return str(folder)
