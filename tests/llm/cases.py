"""Small tables with everything that an operator must stand: nulls, empty and long texts, ties, repeated rows, extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"passage{k} word{k * 7 % 13} of common text" for k in range(16))
LONG = "\n".join(" ".join(f"w{(i * 31 + j * 17) % 997}x{i}" for j in range(12)) for i in range(900))
HEAD = "The opening line of many."


def rows():
    clean = [" ".join(f"tok{(d * 131 + k * 29) % 4001} and" for k in range(40 + d)) + f".\nSecond line {d} here." for d in range(12)]
    out = [(d, t, "en" if d % 2 else "fr", f"src{d % 3}", len(t)) for d, t in enumerate(clean)]
    near = clean[3].split(" ")
    near[11] = "changed"
    extra = [
        (100, None, None, None, None), (101, "", "en", "src0", 0), (102, " \n\t", "en", None, 3), (103, clean[3], "en", "src0", 1), (104, " ".join(near), "en", "src0", 1),
        (105, HEAD + "\n" + PASSAGE + "\nTail one.", "de", "src1", 1), (106, "Other start.\n" + PASSAGE + "\nTail two.", "de", "src1", 1), (107, HEAD, "de", "src1", 1),
        (108, LONG, "de", "src1", len(LONG)), (109, "Größe ÉTÉ 日本語 😀 <|im_end|> <|endoftext|> it's 12 ²½", "de", "src1", 1), (110, "one two three", "de", "src1", 13), (110, "one two three", "de", "src1", 13),
        (111, "one two three", "de", "src1", 13), (None, "no id but words here", "de", "src1", 13), (112, "spam " * 200, "en", "src2", 1000), (113, "%%% ### " * 40, "en", "src2", 1000),
    ]
    return out + extra


def docs(spark):
    """With extra columns that clash with the operators' own names."""
    return spark.createDataFrame([(*r, 7, "x", 1.5) for r in rows()], SCHEMA + ", n_words int, kept string, score double")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
