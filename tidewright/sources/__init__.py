"""Table readers, bar normalisation and parsers of the external text formats."""
