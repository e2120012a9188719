"""A deliberately sequential model of a run: one loop, one dictionary per state."""

from __future__ import annotations


def sec(value):
    number = int(value) if value and str(value).lstrip("-").isdigit() else 0
    return 0 if number <= 0 else number // 1000 if number > 10**12 else number


def fold(feed, index):
    """Actions of (doc, t, ok) in order; ``index`` maps doc to seconds."""
    index, actions = dict(index), []
    for doc, t, ok in feed:
        if doc not in index:
            action = "create"
        else:
            action = "skip" if t == 0 else "update" if t > index[doc] else "skip"
        if action != "skip" and ok:
            index[doc] = t
        actions.append(action)
    return actions, index


def claim(vault, parent, base, doc):
    """Name for a document; the third choice is not checked."""
    for name in (base, f"{base}-{doc[:8]}"):
        if f"{parent}/{name}.md" not in vault:
            return name
    return f"{base}-{doc}"


def claims(rows, taken):
    vault, out = set(taken), {}
    for seq, doc, parent, base in sorted(rows):
        name = claim(vault, parent, base, doc)
        path = f"{parent}/{name}.md"
        out[seq] = (name, path, path in vault)
        vault.add(path)
    return out


def run(feed, media, contents, fetched, index, documents, safe):
    """Results of a run over ``feed`` rows (doc, title, parent, standalone, note_t).

    ``media``: doc -> (type, notebook, url, time, outcome); ``contents``: key -> (text, outcome);
    ``fetched``: url -> (status, type, text, ext); ``index``: doc -> (path, update_time);
    ``documents``: paths that exist; ``safe``: title -> file name.
    """
    index, vault, out = dict(index), set(documents), []
    for doc, title, parent, standalone, note_t in feed:
        if standalone:
            kind, key, url, t = "note", doc, None, sec(note_t)
        else:
            answer = media.get(doc)
            if answer is not None and answer[4] == "quota":
                break
            if answer is None:
                out.append((doc, "failed", None))
                continue
            t = sec(answer[3])
            kind = "note" if answer[0] == 11 or answer[1] else "url" if answer[2] else "none"
            key, url = (answer[1] if answer[1] is not None else doc), answer[2]
        if doc not in index:
            action = "create"
        else:
            known = sec(index[doc][1])
            action = "skip" if t == 0 else "update" if t > known else "skip"
        if action == "skip":
            out.append((doc, "skipped", None))
            continue
        ext = None
        if kind == "note":
            found = contents.get(key)
            if found is not None and found[1] == "quota":
                break
            if found is None or "&#x110000;" in found[0]:
                out.append((doc, "failed", None))
                continue
        elif kind == "url":
            page = fetched.get(url)
            if page is None or page[0] >= 400:
                out.append((doc, "failed", None))
                continue
            if not ("text/html" in page[1] and page[2]):
                ext = page[3]
        else:
            out.append((doc, "failed", None))
            continue
        if action == "update" and index[doc][0] in vault and index[doc][0] in (set(documents) | {p for d, r, p in out if d == doc}):
            path = index[doc][0]
        else:
            name = claim(vault, parent, safe[title], doc)
            path = f"{parent}/{name}.md"
            if ext == "md":
                vault.add(path)
            if path in vault:
                out.append((doc, "failed", None))
                continue
            vault.add(path)
        index[doc] = (path, str(t or ""))
        out.append((doc, "created" if action == "create" else "updated", path))
    return out, index
