"""Given names by gender, which show a name without a title. None is a common word at the start of a sentence."""

from __future__ import annotations

GIVEN = {
    "f": tuple(
        """
        Abigail Agnes Alexandra Alice Alicia Amalia Amanda Amber Amelia Amélie Amy Ana Andrea Angela Anita Anja Ann Anna Anne Annette Annika Antonia Ashley Astrid
        Barbara Beatrice Beatriz Birgit Brenda Brigitte Camille Carla Carmen Carol Caroline Catherine Cécile Charlotte Chloe Chloé Christina Christine Clara Claire Claudia Cristina
        Cynthia Daniela Deborah Denise Diana Donna Dorothy Edith Elena Eleanor Elisabeth Elizabeth Ella Emily Emma Erika Esther Eva Evelyn Fatima Fiona Franziska Françoise
        Gabriela Gertrud Gisela Greta Hannah Heidi Heike Helen Helena Helga Hélène Ines Inés Ingrid Irene Isabel Isabella Isabelle Jacqueline Jana Jane Janet Janice Jennifer Jessica
        Joan Johanna Judith Julia Juliana Julie Juliette Karen Karin Katharina Katherine Kathleen Katja Kelly Kimberly Laura Lauren Lena Léa Linda Lisa Louise Lucía Lucy Luisa Magdalena
        Manon Margaret Margarita María Maria Marie Marina Marion Marta Martha Martina Mary Megan Melanie Melissa Michelle Mia Monica Monika Nadia Nancy Natalia Natalie Nicole Nina Nora
        Olivia Pamela Patricia Paula Petra Pilar Priya Rachel Raquel Rebecca Renate Rosa Ruth Sabine Samantha Sandra Sara Sarah Sharon Silvia Simone Sofia Sofía Sophia Sophie
        Stefanie Stephanie Susan Susanne Sylvie Teresa Theresa Ulrike Ursula Valentina Vanessa Vera Veronica Victoria Wendy Yasmin Yolanda Yvonne Zoe
        Александра Алла Анастасия Анна Валентина Вера Виктория Галина Дарья Екатерина Елена Ирина Ксения Людмила Марина Мария Наталья Нина Оксана Ольга Полина Светлана София Татьяна Юлия
        """.split()
    ),
    "m": tuple(
        """
        Aaron Adam Ahmed Alan Albert Alejandro Alexander Alexandre Alfred Ali Andreas Andrés Andrew Anthony Antoine Antonio Arthur Benjamin Bernd Bernhard Brandon Brian Bruce Carl
        Carlos Charles Christian Christoph Christopher Daniel David Dennis Diego Dieter Dietmar Dmitri Donald Douglas Edward Emil Enrique Eric Ernst Ethan Eugene Felipe Felix Fernando
        Francisco François Friedrich Gabriel Gary Geoffrey Georg George Gerald Gerhard Gregory Günter Gustav Guillaume Hans Harald Harold Harry Heinrich Heinz Helmut Henri Henry
        Hiroshi Hugo Ian Ivan Jacob Jakob James Jan Jason Javier Jean Jeffrey Jens Jeremy Jerry Jesús Joachim Joe Joel Johann Johannes John Jonas Jonathan Jorge José Joseph Joshua Juan
        Julien Jürgen Justin Karl Keith Kenneth Kevin Klaus Kurt Larry Lars Laurent Lawrence Leon Leonard Louis Luca Lucas Luis Lukas Manfred Manuel Marc Marco Marcus Mario Markus
        Martin Mateo Matthew Matthias Michael Michel Miguel Mohamed Mohammed Nathan Nicholas Nicolas Nikolai Noah Olaf Oliver Olivier Oscar Otto Pablo Patrick Paul Pedro Peter Philip Philippe
        Pierre Rafael Rainer Ralf Ralph Ramón Raymond Raúl Ricardo Richard Robert Roberto Roger Roland Ronald Rudolf Russell Ryan Samuel Scott Sean Sebastian Sergei Sergio Stefan Stephen
        Steven Stuart Sven Theodor Thierry Thomas Timothy Tobias Uwe Vincent Vladimir Walter Werner Wilhelm William Wolfgang Yuri Yusuf Zachary
        Александр Алексей Андрей Антон Борис Василий Виктор Владимир Дмитрий Евгений Иван Игорь Константин Максим Михаил Николай Олег Павел Пётр Роман Сергей Юрий
        """.split()
    ),
}
