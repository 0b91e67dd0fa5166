"""Writers: plain text, EPUB, project documents."""
