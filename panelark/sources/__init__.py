"""Readers, writers and panel builders."""
