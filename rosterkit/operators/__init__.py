"""DataFrame operators: sheets, header detection, extraction, compilation, run log, alias library."""
