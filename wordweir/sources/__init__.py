"""Tables, raw files by byte range, stored profiles and resumable runs."""
