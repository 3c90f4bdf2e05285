"""Readers and writers of the files that transcripts come from and go to."""
