import math
import textwrap

from jobmeter.llm import licences as L


def plain_words(text):
    """Written apart from the operator: characters one by one."""
    kept = "".join(c if c.isascii() and (c.isalnum() or c == ".") else " " for c in text.lower())
    while ". " in kept or kept.endswith("."):
        kept = kept[:-1] if kept.endswith(".") else kept.replace(". ", " ")
    return kept.strip(" .").split()


def plain_pairs(words):
    return {words[k] + " " + words[k + 1] for k in range(len(words) - 1)}


def plain_paragraphs(text):
    out, current = [], []
    for line in text.split("\n"):
        bare = line.lstrip(" \t")
        while bare and (mark := next((m for m in ("<!--", "/*", "*/", "//", "--", "#", "*", ";", "%", ">") if bare.startswith(m)), None)):
            bare = bare[len(mark):].lstrip(" \t")
        if bare:
            current.append(bare)
        if current and (not bare or bare.rstrip(" \t").rstrip("\"')")[-1:] in (".", "!", "?")):
            out.append("\n".join(current))
            current = []
    return out + (["\n".join(current)] if current else [])


def brute(model, paragraph, templates):
    words = plain_words(paragraph)
    if not set(words) & set(model.anchors) or len(set(words) & set(model.telling)) < L.LEAST_WORDS:
        return None
    own = plain_pairs(words)
    z = list(model.bias)
    for g in ({*words} | own) & model.weights.keys():
        z = [a + b for a, b in zip(z, model.weights[g])]
    e = [math.exp(v - max(z)) for v in z]
    guess = model.families[z.index(max(z))]
    best = (False, 0)
    for t in map(plain_pairs, map(plain_words, templates.get(guess, ()))):
        share = 100 * len(own & t) // len(t)
        rivals = [plain_pairs(plain_words(u)) for f, texts in templates.items() if f != guess for u in texts]
        lacking = [t - u for u in rivals if 100 * len(t & u) >= L.RELATED * len(t)]
        best = max(best, (share >= L.CONFIRMED and all(m and 2 * len(own & m) >= len(m) for m in lacking), share))
    sure = best[0] and 1 / sum(e) >= 0.5
    return (guess if sure else L.UNKNOWN, round(1 / sum(e), 5), best[1], sure)


LINES = [t for texts in L.TEMPLATES.values() for t in texts] + list(L.OTHERS) + [
    "licensed under the mit license", "see the License file, released  under the MIT   license. thanks", "nothing here", "Released under a free license of our own",
    "GNU GENERAL PUBLIC LICENSE version 3", "", "license license software"]


def test_templates_are_found_and_others_are_not(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(LINES)], "doc_id long, text string")
    found = {r.doc_id: r for r in L.scan(docs).collect()}
    wanted = [f for f, texts in L.TEMPLATES.items() for _ in texts]
    right = [k for k, f in enumerate(wanted) if k in found and found[k].family == f]
    assert len(right) >= 0.9 * len(wanted)
    assert all(found[k].family in (f, L.UNKNOWN) for k, f in enumerate(wanted) if k in found)
    assert all(found[k].family == L.UNKNOWN for k in range(len(wanted), len(wanted) + len(L.OTHERS)) if k in found)


def test_scan_against_brute_force(spark):
    model = L.train()
    texts = {1: "\n\n".join(LINES), 2: "\n\n" + LINES[0], 3: "\n".join(LINES), 4: "# " + "\n# ".join(LINES[:20]), 5: "\n".join(w for t in LINES[:30] for w in t.split())}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.paragraph): (r.family, round(r.probability, 5), r.similarity, r.confirmed) for r in L.scan(docs, model).collect()}
    want = {(d, k): b for d, text in texts.items() for k, p in enumerate(plain_paragraphs(text)) if (b := brute(model, p, L.TEMPLATES))}
    assert got.keys() == want.keys()
    for k in got:
        assert got[k][0] == want[k][0] and got[k][2:] == want[k][2:] and abs(got[k][1] - want[k][1]) < 2e-5


def gnu(name, version):
    return (f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the "
            f"Free Software Foundation, either version {version} of the License, or (at your option) any later version.")


# Notices as they stand in files; those of the last family are under no licence that is known here.
HEADERS = [
    ("GPL-2.0", gnu("General", 2)), ("GPL-3.0", gnu("General", 3)), ("AGPL-3.0", gnu("Affero General", 3)), ("LGPL", gnu("Lesser General", 3)), ("LGPL", gnu("Lesser General", 2.1)),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
            "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    *[(f, f"This work is licensed under a Creative Commons {n} {v} License.") for f, n in L.COMMONS.items() for v in L.COMMONS_VERSIONS],
    ("unknown", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. See the GNU Affero General Public License for more details."),
    ("unknown", "Licensed under the European Union Public Licence, version 1.2"),
    ("unknown", "you can redistribute it and/or modify it under the terms of the GNU Imaginary Public License as published by the Free Software Foundation, either version 3"),
    ("unknown", "This work is licensed under a Creative Commons Attribution-Imaginary 4.0 International License."),
]


def test_wrapped_headers_and_relatives(spark):
    forms = {"one": lambda t: t, "wrapped": lambda t: "\n".join(textwrap.wrap(t, 70)), "narrow": lambda t: "\n".join(textwrap.wrap(t, 40)),
             "hash": lambda t: "\n".join("# " + x for x in textwrap.wrap(t, 70)), "stars": lambda t: "/*\n" + "\n".join(" * " + x for x in textwrap.wrap(t, 60)) + "\n */"}
    rows = [(f"{k} {name}", "Prose goes on\nand ends.\n\n" + form(text)) for k, (_, text) in enumerate(HEADERS) for name, form in forms.items()]
    found = {}
    for r in L.scan(spark.createDataFrame(rows, "doc_id string, text string")).where("confirmed").collect():
        found.setdefault(r.doc_id, set()).add(r.family)
    want = {f"{k} {name}": {family} for k, (family, _) in enumerate(HEADERS) if family != "unknown" for name in forms}
    assert found == want


def test_own_templates_are_compared(spark):
    templates = {"House": ("This text is shared under the house rules of the club.",), "MIT": L.TEMPLATES["MIT"]}
    docs = spark.createDataFrame([(1, "This text is shared under\nthe house rules of the club."), (2, "Released under the MIT License."), (3, L.TEMPLATES["BSD"][0])], "doc_id long, text string")
    got = {r.doc_id: r.family for r in L.scan(docs, L.train(templates)).where("confirmed").collect()}
    assert got == {1: "House", 2: "MIT"}


def test_notices_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.family, r["count"]) for r in L.scan(docs).groupBy("family").count().collect()}
    marks = {"Apache-2.0": "Apache License", "MIT": "MIT License", "GPL-3.0": "GNU General", "CC-BY-NC": "CC BY-NC"}
    assert got == {(f, docs.where(docs.text.contains(m)).count()) for f, m in marks.items()}


def test_odd_rows(odd_docs, no_docs):
    assert L.scan(odd_docs).count() == 0 and L.scan(no_docs).count() == 0
    plan = L.scan(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_notices_without_common_words_are_found(spark):
    """Notices cut short, without any of the few words of which each template has one, and one in marks; the rest of a template confirms them."""
    model = L.train()
    texts = [("CC-BY-NC-SA", "CC BY-NC-SA 4.0"), ("AGPL-3.0", "Identifier: AGPL-3.0-only"),
             ("CC0-1.0", "By law the author has waived all copyright and related or neighboring rights to this work."), ("MIT", "Released _under_ the MIT _License_.")]
    assert not any(set(plain_words(t)) & set(model.anchors) for _, t in texts[:-1])
    # Whatever is cut off a template at both ends: without a word of the cover, what is left does not confirm it.
    for words in (plain_words(t) for ts in L.TEMPLATES.values() for t in ts):
        for part in (words[a:b] for a in range(len(words)) for b in range(a, len(words) + 1)):
            enough = 100 * len(plain_pairs(part) & plain_pairs(words)) // len(plain_pairs(words)) >= L.CONFIRMED
            assert not enough or plain_pairs(part) & set(model.cover)
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)] + [(9, "He will copy a form and a general is free of charge.")], "doc_id long, text string")
    assert {r.doc_id: r.family for r in L.scan(docs, model).where("confirmed").collect()} == {k: f for k, (f, _) in enumerate(texts)}
    assert L.scan(docs, model).where("doc_id = 9").count() == 0
