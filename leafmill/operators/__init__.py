"""Set-oriented operators over documents, pages, lines and segments."""
