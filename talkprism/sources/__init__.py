"""Transcript sources: files to lines, lines to records; repository changes; tables of turns."""
