"""Small tables for the text operators: nulls, empty and long texts, repeated rows, extra columns with clashing names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, _text string, length int"


def docs_of(spark, texts, schema=DOCS, first=0):
    rows = [(first + i, t, "en", "s", None if t is None else len(t), 7, "x", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


ODD = [
    None, "", " \n\t ", "one", "one two three", "one two three four", "ONE two three four", "1234 5678 !!", "é" * 5000, "word " * 20000,
    "日本語のテキストです", "Привет мир как дела", "tab\tand\x0bvertical\x0cfeed and non breaking", "<|endoftext|> 'tis don't", "\x00\x01", "same text", "same text", "same text",
]
