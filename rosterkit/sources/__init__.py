"""Sources and sinks: file catalog, delimited text, workbooks, archives, alias files, result tables."""
