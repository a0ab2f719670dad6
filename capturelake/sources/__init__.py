"""Readers and writers for image folders, run logs, model text and reports."""
