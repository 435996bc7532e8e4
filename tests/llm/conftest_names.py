LABELS = "doc_id long, quality int, toxic int"
BENCH = "item_id long, text string"
VECTORS = "vec_id long, embedding array<float>, label int"
