"""Incremental runs. No operator here keeps stream state; work is resumed by what is already written."""
