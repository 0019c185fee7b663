"""Recognition of text in images: detection post-processing, decoding and placement; the models are given from outside."""
