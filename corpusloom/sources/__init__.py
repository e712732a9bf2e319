"""Readers of source trees and writers of reports."""
