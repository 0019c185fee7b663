"""Sources: typeset text, PDF files, images, annotations, dimensions."""
