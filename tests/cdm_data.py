"""Small delimited files for the six-entity model, one defect at a time."""

import os

# Code lists written for the tests (code|description).
CATALOGS = {
    "menopause_cd_catalog.csv": "code|description\n0|unknown\n1|premenopausic\n2|perimenopausic\n3|postmenopausic\n",
    "smoking_status_cd_catalog.csv": "code|description\n0|never\n1|former\n2|current\n",
    "initial_treatment_cd_catalog.csv": "code|description\n0|none\n1|surgery\n2|chemo\n3|other\n",
    "lesion_mass_shape_cd_catalog.csv": "code|description\n|\n0|unknown\n1|oval\n2|round\n3|irregular\n4|other\n",
    "manufacturer_id_catalog.csv": "code|description\nSIEMENS|s\nGE|g\nFUJI|f\nAGFA|a\nPHILLIPS|p\nUNK|NA\n",
}


def default_cell(label, fmt, i):
    if label == "woman_id":
        return f"W{i}"
    if fmt == "string":
        return f"{label[:6]}{i}"
    if fmt == "date":
        return f"19{70 + i % 30}-01-{1 + i % 28:02d}"
    if fmt == "integer":
        return "1"
    if fmt == "boolean":
        return "true"
    if fmt == "double":
        return "60.5"
    return "x"


def rows_for(entity, n, start=1, **overrides):
    """``n`` rows as dicts; ``overrides`` maps label -> function(i) -> text."""
    out = []
    for i in range(start, start + n):
        r = {v.label: default_cell(v.label, v.fmt, i) for v in entity.variables}
        if "menarque_age_nm" in r:
            r["menarque_age_nm"], r["menopause_age_nm"] = "12", "50"
        for k, f in overrides.items():
            r[k] = f(i)
        out.append(r)
    return out


def write_csv(folder, name, columns, rows, sep="|"):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(sep.join(columns) + "\n")
        for r in rows:
            f.write(sep.join(r[c] for c in columns) + "\n")
    return path


def write_catalogs(folder):
    os.makedirs(folder, exist_ok=True)
    for name, body in CATALOGS.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(body)
    return folder
