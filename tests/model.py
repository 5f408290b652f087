"""Plain model of key/value pairing, one document at a time, to check the operators."""


def pairs(blocks: list[dict], mode: str):
    """List of ``(key, value, key confidence, value confidence)``, or None for a reject."""
    every, keys, values = {}, {}, {}
    for b in blocks:
        every[b["Id"]] = b
        if b["BlockType"] != "KEY_VALUE_SET":
            continue
        kinds = b["EntityTypes"]
        if kinds is None:
            if mode == "form":
                return None
            kinds = []
        if "KEY" in kinds:
            keys[b["Id"]] = b
        elif mode == "form" or "VALUE" in kinds:
            values[b["Id"]] = b

    def ids(block, kind):
        return [i for r in block["Relationships"] or [] if r["Type"] == kind for i in r["Ids"]]

    def words(block):
        out = []
        for i in ids(block, "CHILD"):
            child = every.get(i)
            if child is None:
                if mode == "form":
                    raise KeyError(i)
                continue
            if child["BlockType"] == "WORD":
                out.append(child["Text"])
            elif (
                mode == "form"
                and child["BlockType"] == "SELECTION_ELEMENT"
                and child["SelectionStatus"] == "SELECTED"
            ):
                out.append("X")
        return out

    rows = []
    try:
        for block in keys.values():
            targets = ids(block, "VALUE")
            if mode == "form":
                targets = targets[:1]
            found = [values[t] for t in targets if t in values]
            text = [w for v in found for w in words(v)]
            conf = (found[-1]["Confidence"] or 0.0) if found else 0.0
            rows.append(
                (
                    " ".join(words(block)).strip(),
                    " ".join(text).strip(),
                    block["Confidence"] or 0.0,
                    conf,
                )
            )
    except KeyError:
        return None
    if mode == "id":
        return rows
    grouped: dict[str, list] = {}
    for r in rows:
        grouped.setdefault(r[0], []).append(r)
    return [r for g in grouped.values() for r in g]
