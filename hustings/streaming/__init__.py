"""hustings.streaming"""
